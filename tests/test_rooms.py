"""Rooms, drift and placing on scenes with known answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planspark.operators import drift, geometry, placing, rooms, similarity, walls


def _cells(spark, *boxes, key="a"):
    rows = {(key, c, r) for c0, c1, r0, r1 in boxes for c in range(c0, c1) for r in range(r0, r1)}
    return spark.createDataFrame(sorted(rows), "k string, col long, row long")


def test_two_rooms_are_split_at_their_door(spark):
    inside = _cells(spark, (0, 40, 0, 40), (40, 44, 18, 24), (44, 84, 0, 40), (200, 215, 0, 15))
    track = spark.createDataFrame([("a", 20, 20), ("a", 60, 20)], "k string, col long, row long")
    found = rooms.split(inside, track, "k", 0.1)
    sizes = {r.room: r["count"] for r in found.groupBy("room").count().collect()}
    assert set(sizes) == {1, 2} and all(1590 <= n <= 1640 for n in sizes.values())
    edges = rooms.outlines(found, "k", 0.1)
    got = {r.room: r for r in walls.records(edges.withColumn("sigma", F.lit(0.0)), ["k", "room"], 0.0, 0.0).collect()}
    assert all(r.floor_area.value == pytest.approx(16, abs=0.5) for r in got.values())
    assert [tuple(r) for r in rooms.passages(found, inside, "k").collect()] == [("a", 1, 2)]
    apart = _cells(spark, (0, 40, 0, 40), (45, 85, 0, 40))
    two = rooms.split(apart, track, "k", 0.1)
    assert two.select("room").distinct().count() == 2 and rooms.passages(two, apart, "k").count() == 0
    assert rooms.split(apart, track.limit(0), "k", 0.1).count() == 0


def test_core_and_labels_brute_force():
    rng = np.random.default_rng(1)
    mask = rng.random((25, 30)) > 0.06
    wide = np.pad(mask, 5)
    holes = np.argwhere(~wide)
    for radius in (1.0, 2.3, 3.0):
        want = np.array([[mask[y, x] and ((holes - [y + 5, x + 5]) ** 2).sum(1).min() > radius**2 for x in range(30)] for y in range(25)])
        assert (rooms.core(mask, radius) == want).all()
    mask = rng.random((20, 20)) > 0.55
    for diagonal in (True, False):
        got = rooms.labels(mask, diagonal)
        assert ((got > 0) == mask).all()
        for (y, x), (v, u) in itertools.combinations(np.argwhere(mask).tolist(), 2):
            d = abs(y - v) + abs(x - u)
            if d == 1 or (diagonal and max(abs(y - v), abs(x - u)) == 1):
                assert got[y, x] == got[v, u]
        seen = set()
        for k in range(1, got.max() + 1):  # each number is one piece
            todo, own = [tuple(np.argwhere(got == k)[0])], set()
            while todo:
                y, x = todo.pop()
                if (y, x) in own or not (0 <= y < 20 and 0 <= x < 20) or got[y, x] != k:
                    continue
                own.add((y, x))
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not (a and b)]
            assert len(own) == (got == k).sum() and not own & seen
            seen |= own


def test_outline_of_an_l(spark):
    mask = np.zeros((12, 14), bool)
    mask[2:10, 2:6] = True
    mask[2:5, 2:12] = True
    ring = rooms.boundary(mask)
    assert sorted(map(tuple, ring.tolist())) == [(2, 2), (2, 10), (5, 6)[::-1], (6, 10), (12, 2), (12, 5)]
    area = 0.5 * np.sum(ring[:, 0] * np.roll(ring[:, 1], -1) - ring[:, 1] * np.roll(ring[:, 0], -1))
    assert area == mask.sum()
    noisy = np.array([(0, 0), (4, 0.05), (8, 0), (8, 6), (4, 6.04), (0, 6)], float)
    assert rooms.simplified(noisy, 0.1).tolist() == [[0, 0], [8, 0], [8, 6], [0, 6]]


def test_interior_by_rays_and_by_walls(spark):
    rng = np.random.default_rng(0)
    side = rng.uniform(0, 4, 12000)
    height = rng.uniform(0.05, 1.95, 12000)
    edge = [[(s, h, 0.0) for s, h in zip(side[:3000], height[:3000], strict=True)], [(s, h, 4.0) for s, h in zip(side[3000:6000], height[3000:6000], strict=True)], [(0.0, h, s) for s, h in zip(side[6000:9000], height[6000:9000], strict=True)], [(4.0, h, s) for s, h in zip(side[9000:], height[9000:], strict=True)]]
    points = spark.createDataFrame([(1, *map(float, p)) for e in edge for p in e], "k int, x double, y double, z double")
    rays = points.selectExpr("k", "2e0 as x0", "2e0 as z0", "x as x1", "z as z1")
    cameras = spark.createDataFrame([(1, 2.0, 2.0)], "k int, x double, z double")
    for carve in (True, False):
        found = rooms.maps(points, rays, cameras, "k", 0.1, carve)
        assert 13.5 <= found["interior"].count() * 0.01 <= 16.5
        assert 120 <= found["walls"].count() <= 260


def test_hull_cells(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("a", 4, 0), ("a", 4, 4), ("a", 2, 1), ("a", 0, 4)], "k string, col long, row long")
    assert geometry.hull_cells(cells, "k").count() == 25


def test_polygon_overlap_by_sampling():
    rng = np.random.default_rng(4)

    def inside(p, x, y):
        q = np.roll(p, -1, 0)
        return sum(((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1] + 1e-300) + a[0]) for a, b in zip(p, q, strict=True)) % 2 == 1

    x, y = rng.uniform(-3, 3, (2, 200_000))
    for _ in range(6):
        rings = []
        for _ in range(2):
            angle = np.sort(rng.uniform(0, 2 * np.pi, 9))
            radius = rng.uniform(0.5, 2, 9)
            rings.append(np.stack([radius * np.cos(angle) + rng.uniform(-0.5, 0.5), radius * np.sin(angle)], 1))
        want = (inside(rings[0], x, y) & inside(rings[1], x, y)).mean() * 36
        assert geometry.overlap_area(*rings) == pytest.approx(want, abs=0.12)


def _pose(rng, yaw=None):
    out = np.eye(4)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    out[:3, :3] = q * np.sign(np.linalg.det(q)) if yaw is None else placing.upright_turn(yaw)
    out[:3, 3] = rng.normal(size=3)
    return out


def test_windows_chain_to_one_frame(spark):
    """Random frame and scale of every window: chaining recovers the poses of the first window's frame."""
    rng = np.random.default_rng(3)
    truth = [_pose(rng) for _ in range(26)]
    rows, steps = [], []
    frames = [(1.0, np.eye(3), np.zeros(3))] + [(float(rng.uniform(0.5, 2)), _pose(rng)[:3, :3], rng.normal(size=3)) for _ in range(3)]
    for w, (s, r, t) in enumerate(frames):
        for i in range(w * 6, w * 6 + 8):
            p = placing.moved_pose(truth[i], s, r, t)
            rows.append((1, w, i, *p[:3, :3].reshape(-1).tolist(), *p[:3, 3].tolist(), s))
    names = "k int, window int, view int, " + ", ".join(f"p{i} double" for i in range(9)) + ", x double, y double, z double, s double"
    views = spark.createDataFrame(rows, names)
    a = views.selectExpr("k", "window + 1 as window", "view", *[f"p{i} as a{i}" for i in range(9)], *[f"{c} as a{c}" for c in "xyz"], "s as sa")
    b = views.selectExpr("k", "window", "view", *[f"p{i} as b{i}" for i in range(9)], *[f"{c} as b{c}" for c in "xyz"], "s as sb")
    both = a.join(b, ["k", "window", "view"])
    scales = both.groupBy("k", "window").agg(F.first(F.col("sa") / F.col("sb")).alias("s"))
    steps = similarity.shared_views(both, ["k", "window"], scales)
    first = spark.createDataFrame([(1, 0, 1.0, *np.eye(3).reshape(-1).tolist(), 0.0, 0.0, 0.0)], steps.schema)
    chain = similarity.chained(first.unionByName(steps), ["k"])
    assert chain.count() == 4
    found = similarity.placed(views.drop("s"), ["k", "window"], chain.withColumn("window", F.col("window").cast("int")))
    for r in found.collect():
        assert np.allclose([r.x, r.y, r.z], truth[r.view][:3, 3], atol=1e-6)
        assert np.allclose([r[f"p{i}"] for i in range(9)], truth[r.view][:3, :3].reshape(-1), atol=1e-6)


def test_umeyama_and_gravity(spark):
    rng = np.random.default_rng(5)
    r, t, s = _pose(rng)[:3, :3], rng.normal(size=3), 1.7
    b = rng.normal(size=(40, 3))
    a = s * b @ r.T + t
    rows = spark.createDataFrame([(1, *p, *q) for p, q in zip(a.tolist(), b.tolist(), strict=True)], "k int, ax double, ay double, az double, bx double, by double, bz double")
    got = similarity.fitted_points(rows, ["k"]).first()
    assert got.s == pytest.approx(s) and np.allclose([got[f"r{i}"] for i in range(9)], r.reshape(-1)) and np.allclose([got.tx, got.ty, got.tz], t)
    tilt = np.array([[1, 0, 0], [0, math.cos(0.2), -math.sin(0.2)], [0, math.sin(0.2), math.cos(0.2)]])
    floor = np.c_[rng.uniform(-2, 2, 3000), rng.normal(0, 0.005, 3000), rng.uniform(-2, 2, 3000)]
    clutter = np.c_[rng.uniform(-2, 2, 800), rng.uniform(0, 2, 800), rng.uniform(-2, 2, 800)]
    cloud = spark.createDataFrame([(1, *p) for p in (np.concatenate([floor, clutter]) @ tilt.T).tolist()], "k int, x double, y double, z double")
    eyes = (np.array([[0, 1.5, 0.1 * i] for i in range(5)]) @ tilt.T).tolist()
    down = (tilt @ [0.05, -1, 0.08]).tolist()
    cameras = spark.createDataFrame([(1, *e, *down) for e in eyes], "k int, x double, y double, z double, dx double, dy double, dz double")
    g = similarity.gravity(cloud, cameras, ["k"]).first()
    up = np.array([g[f"r{i}"] for i in range(9)]).reshape(3, 3) @ tilt @ [0, 1, 0]
    assert np.degrees(np.arccos(up[1])) < 0.5


def test_drift_is_found_and_spread(spark):
    rng = np.random.default_rng(8)
    wall = np.concatenate([np.c_[rng.uniform(0, 4, 1500), np.zeros(1500)], np.c_[np.zeros(1000), rng.uniform(0, 3, 1000)], np.c_[rng.uniform(1, 2, 600), np.full(600, 1.7)], np.c_[np.full(700, 4.0), rng.uniform(0, 2, 700)]])
    centre = wall.mean(0)
    drifted = (wall - centre) @ drift.turn(np.radians(-2.0)).T + centre - [0.12, -0.08]
    points = [(1, f, *p) for f, own in ((0, wall), (3, drifted)) for p in own.tolist()]
    rows = spark.createDataFrame(points, "k int, fragment long, x double, z double")
    links = drift.revisits(rows, spark.createDataFrame([(1, 0, 3)], "k int, i long, j long"), "k")
    r = links.first()
    assert math.degrees(r.yaw) == pytest.approx(2.0, abs=0.6) and (r.dx, r.dz) == (pytest.approx(0.12, abs=0.05), pytest.approx(-0.08, abs=0.05)) and r.after > r.before
    nodes = spark.createDataFrame([(1, f, float(f), 0.0) for f in range(4)], "k int, fragment long, cx double, cz double")
    fixed = {x.fragment: x for x in drift.pose_graph(nodes, links, "k").collect()}
    assert fixed[0].a == 0 and 0 < fixed[1].a < fixed[2].a < fixed[3].a
    assert {x.a for x in drift.pose_graph(nodes, links.limit(0), "k").collect()} == {0.0}


def test_camera_pose_and_verified_matches():
    rng = np.random.default_rng(2)
    points = rng.uniform([-2, 0, 2], [2, 2.5, 6], (40, 3))
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    own, yaw, centre = np.eye(3), np.radians(12), np.array([0.3, 1.2, -0.4])

    def project(turn, c, p):
        at = (p - c) @ turn
        return at[:, :2] / at[:, 2:] * [k[0, 0], k[1, 1]] + [k[0, 2], k[1, 2]]

    pixels = project(placing.upright_turn(yaw) @ own, centre, points)
    pixels[:6] += 200
    got = placing.camera_pose(points, pixels, k, own)
    assert math.degrees(got[0]) == pytest.approx(12) and np.allclose(got[1], centre, atol=1e-6) and got[2] == 34
    other = project(placing.upright_turn(0.1), np.array([-0.5, 1.0, 0.2]), points)
    ok = placing.fundamental_inliers(pixels, other)
    assert ok[6:].all() and ok[:6].sum() <= 2 and not placing.fundamental_inliers(pixels[:9], other[:9]).any()
    assert placing.camera_pose(points[:5], pixels[:5], k, own) is None


def test_groups_merge_strongest_first():
    room = np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float)
    rooms_ = {"hall": room, "bath": room, "bed": room, "far": room}
    links = [{"a": "hall", "b": "bath", "yaw": 0.05, "t": (4.5, 0.0), "inliers": 90}, {"a": "bath", "b": "bed", "yaw": math.pi / 2 + 0.04, "t": (4.2, 0.0), "inliers": 60}, {"a": "hall", "b": "bed", "yaw": 0.0, "t": (1.0, 0.0), "inliers": 30}, {"a": "hall", "b": "far", "yaw": 0.0, "t": (0.2, 0.0), "inliers": 20}]
    places, taken = placing.merged_groups(rooms_, dict.fromkeys(rooms_, 0.0), links)
    assert set(places) == {"hall", "bath", "bed"} and [x["inliers"] for x in taken] == [90, 60]
    assert places["bath"][0] == pytest.approx(0) and places["bed"][0] == pytest.approx(math.pi / 2)
    for a, b in itertools.combinations(places, 2):
        assert placing.clash(rooms_, {a: places[a]}, {b: places[b]}) <= 0.15
    assert placing.merged_groups({"one": room}, {"one": 0.0}, []) == ({}, [])


def test_pieces_join_through_bridges():
    rng = np.random.default_rng(6)
    truth = [_pose(rng) for _ in range(60)]
    own = lambda frames, s: (lambda m: {f: placing.moved_pose(truth[f], s, *m) for f in frames})((_pose(rng)[:3, :3], rng.normal(size=3)))
    pieces = [dict(enumerate(truth[:30])), own(range(33, 50), 1.0), own(range(54, 60), 1.0)]
    world, log = placing.joined_pieces(pieces, lambda frames: list(own(frames, 3.0).values()))
    assert [x["joined"] for x in log] == [True, True]
    assert set(world) == {*range(30), *range(33, 50), *range(54, 60)}
    assert all(np.allclose(world[f], truth[f], atol=1e-6) for f in world)
    _, log = placing.joined_pieces(pieces, lambda frames: list(own(frames, 3.0).values()), most_gap=5)
    assert [x["joined"] for x in log] == [False, False]
