"""Operators with known answers on small fixtures."""

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from planspark.functions import scalars
from planspark.operators import geometry, graph, joins, points, rules, runs
from planspark.plans import config, registry
from planspark.sources import capture


def test_square_room_raster(spark):
    wall = [(k / 50, 0.0) for k in range(200)] + [(k / 50, 4.0) for k in range(200)] + [(0.0, k / 50) for k in range(200)] + [(4.0, k / 50) for k in range(200)]
    cells = points.raster(spark.createDataFrame(wall, "x double, z double"), 0.02)
    assert 700 <= cells.count() <= 804
    ring = geometry.edges(spark.createDataFrame([(1, i, u, v) for i, (u, v) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "r int, i int, u double, v double"), ["r"])
    row = geometry.signed_area(ring, ["r"]).first()
    assert (row.area, row.perimeter) == (16.0, 16.0)


def test_floor_below_denser_desk(spark):
    ys = [0.0 + k * 1e-4 for k in range(60)] + [0.65 + k * 1e-4 for k in range(100)] + [2.7] * 90
    rows = spark.createDataFrame([(1, y) for y in ys], "c int, y double")
    assert points.floor_level(rows, 1.5, ["c"]).first().bin in (0, 1)


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    groups = {1: rng.normal(size=501), 2: np.repeat([3.0, 7.0], [400, 5]), 3: np.array([4.0]), 4: rng.integers(0, 5, 200).astype(float), 5: np.array([])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(5, None), (1, None)], "k int, v double")
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.985, "e": 1.0}
    got = {r.k: r for r in points.quantiles(rows, "v", shares, ["k"], bins=16).collect()}
    assert set(got) == {1, 2, 3, 4}
    for k in got:
        assert [got[k][n] for n in shares] == pytest.approx([float(np.quantile(groups[k], p)) for p in shares.values()])


def test_door(spark):
    slots = [(1, s, 30 <= s < 48, 0.0 if 30 <= s < 48 else None) for s in range(80)]
    door = runs.open_runs(spark.createDataFrame(slots, "wall int, slot int, open boolean, sill double"), ["wall"], 0.05).collect()
    assert [(round(r.offset, 3), round(r.width, 3), r.kind) for r in door] == [(1.5, 0.9, "door")]


def test_water_stain_rules(spark):
    region = [("r1", 1, "water_stain", "wall", "w1", 0.1, 0.4, 0.2, 4.0, 2.7, 12.0)]
    rows = spark.createDataFrame(region, "room_id string, d_ord int, class string, surface string, surface_id string, bottom double, length double, area double, wall_length double, ceiling double, floor_area double")
    assert [r.rule_id for r in rules.concealed_flags(rows, ["room_id"]).collect()] == ["R-WATER-BASE"]
    items = {r.code: r.value for r in rules.scope_items(rows, ["room_id"]).collect()}
    assert set(items) == {"DRY-SEAL", "PNT-WALL", "DRY-FLOOD", "DRY-RPL"} and items["PNT-WALL"] == pytest.approx(10.8)


def test_suppression_keeps_best(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.3), (1, 1, 1.0, 0.0, 11.0, 10.0, 0.5), (1, 2, 50.0, 50.0, 60.0, 60.0, 0.4)], "image int, box_id int, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(r.box_id for r in graph.non_maximum(boxes, ["image"]).collect()) == [1, 2]


def test_components_and_tree(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)], "a long, b long")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 6, 9)], "node long")
    assert dict(map(tuple, graph.components(nodes, links).collect())) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    assert {r.node: (r.parent, r.depth) for r in graph.tree(links, spark.createDataFrame([(1,)], "node long")).collect()} == {1: (None, 0), 2: (1, 1), 3: (2, 2)}


def test_index_windows(spark):
    rows = runs.index_windows(spark.createDataFrame([(1, 10), (2, 3)], "c int, n long"), 4, 2, ["c"]).collect()
    assert sorted((r["first"], r["last"]) for r in rows if r.c == 1) == [(0, 3), (2, 5), (4, 7), (6, 9)]
    assert [(r["first"], r["last"]) for r in rows if r.c == 2] == [(0, 2)]


def _matches_sql(spark, name, table, rows, schema, folder):
    """The query and its SQL over one made-up table; returns the query's frame."""
    import duckdb

    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    ours, theirs = registry.queries()[name](spark, str(folder)), con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    want = theirs.fetchall()
    assert want and sorted(map(repr, map(tuple, ours.select(*names).collect()))) == sorted(map(repr, want))
    return ours


def _orders(n):
    """Frames of three captures in turn and some without one."""
    return [(k, None if k % 10 == 9 else k * 7 % 3, "O", 1.0) for k in range(n)]


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shared_views_come_from_bounds(spark, tmp_path):
    """No view of its own row, no join that AQE could broadcast; captures without a name count as one."""
    assert "Join" not in _plan(_matches_sql(spark, "j12_shared_views", "orders", _orders(400), ORDERS, tmp_path))
    rows = runs.window_overlaps(spark.createDataFrame([(1, 11), (2, 3), (3, 4), (4, 6)], "c int, n long"), 4, 2, ["c"]).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 2), (1, 2, 2), (1, 4, 2), (1, 6, 3), (4, 0, 2)]


def test_pose_gaps_in_two_passes(spark, tmp_path):
    """No frame runs to the end of its partition, where Spark evaluates it anew for each row."""
    assert "unboundedfollowing" not in _plan(_matches_sql(spark, "p26_pose_gaps", "orders", _orders(200), ORDERS, tmp_path)).lower()
    rows = spark.createDataFrame([(1, 2, None), (1, 4, "d"), (1, 5, None), (1, 7, "g"), (1, 9, None), (2, 1, None)], "c int, t int, v string")
    found = {(r.c, r.t): (r.p, r.q) for r in runs.brackets(rows, ["c"], "t", F.col("v"), "p", "q").collect()}
    assert found == {(1, 2): (None, "d"), (1, 4): ("d", "d"), (1, 5): ("d", "g"), (1, 7): ("g", "g"), (1, 9): ("g", None), (2, 1): (None, None)}


def test_nearest_in_time_in_two_passes(spark, tmp_path):
    """No frame runs to the end of its partition; repeated frames and frames without a capture as in the SQL."""
    assert "unboundedfollowing" not in _plan(_matches_sql(spark, "j10_nearest_in_time", "orders", _orders(200) + _orders(30), ORDERS, tmp_path)).lower()
    times = lambda *t: spark.createDataFrame([(1, x, x) for x in t], "c int, id long, t long")
    found = joins.nearest_in_time(times(0, 10, 20, 33, 50), times(5, 15, 21, 40), ["c"]).collect()
    assert sorted((r.id, r.match, r.gap) for r in found) == [(0, 5, 5), (10, 5, 5), (20, 21, 1), (33, 40, 7), (50, 40, 10)]


def test_doors_in_one_place_meet_once(spark, tmp_path, monkeypatch):
    """Of doors in one place the first is compared; the pairs grow with the places, not with the doors."""
    pairs, near = [], joins.near_pairs

    def counted(*args):
        pairs.append((found := near(*args)).count())
        return found

    monkeypatch.setattr(joins, "near_pairs", counted)
    parts = [(k, 1) for start in (0, 900, 1800) for k in range(start, start + 40)] + [(5, 1), (None, 1)]
    _matches_sql(spark, "j15_door_match", "part", parts, "p_partkey long, p_size int", tmp_path)
    places = [(3 * (k * 13 % 150 / 100 + 3e-4), 5 * (k * 19 % 90 / 100 + 3e-4)) for k in range(40)]
    assert pairs == [sum(math.dist(p, q) <= 0.601 for k, p in enumerate(places) for q in places[:k])]


def test_slerp_in_two_passes(spark, tmp_path):
    """No frame runs to the end of its partition."""
    assert "unboundedfollowing" not in _plan(_matches_sql(spark, "p26_slerp", "orders", _orders(200), ORDERS, tmp_path)).lower()


def test_even_picks(spark):
    rows = spark.createDataFrame([(1, i) for i in range(11)], "c int, i int")
    assert runs.even_picks(rows, 8, ["c"], ["i"]).count() == 8


def test_scalars(spark):
    row = spark.range(1).select(F.round(scalars.rotation(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))[1], 6).alias("r"), scalars.snap_yaw(F.lit(1.5)).alias("y"), scalars.cell(F.lit(-0.01), 0.05).alias("c"), scalars.focal_px(F.lit(None).cast("double"), F.lit(4000.0), F.lit(3000.0)).alias("f")).first()
    assert (row.r, row.c) == (-1.0, -1) and row.y == pytest.approx(math.pi / 2) and row.f == pytest.approx(13 * 5000 / math.hypot(36, 24))


def test_config():
    base = {"a": {"b": 1, "c": 2}, "d": 3, "drift": {"method": "posegraph"}}
    assert config.layered(base, {"a": {"b": 5}}, settings=("a.c=7", "drift.method=off"))["a"] == {"b": 5, "c": 7}
    assert config.layered(base, settings=("drift.method=off",))["drift"]["method"] == "off"
    for wrong in ({"a": {"x": 1}}, {"a": 1}, {"d": {"x": 1}}, {"drift": {"method": "on"}}):
        with pytest.raises(config.SettingError):
            config.layered(base, wrong)
    with pytest.raises(config.SettingError):
        config.setting("a.b")
    assert config.digest(base) != config.digest({**base, "d": 4})
    own = config.load("lite", "recon: {video_fps: 4.0}\ndamage: {backend: off}", ("recon.image_long_side=518",))
    assert (own["recon"]["max_views"], own["recon"]["video_fps"], own["damage"]["backend"]) == (3, 4.0, "off")
    assert config.yaml.safe_load(config.dump(own, "lite", {"ram_gb": 8}))["_meta"]["digest"] == config.digest(own)
    for wrong in (("lite", "", ("recon.image_long_side=500",)), ("none", "", ()), ("lite", "recon: {fps: 1}", ())):
        with pytest.raises(config.SettingError):
            config.load(*wrong)


def _png(width, height, samples):
    raw = b"".join(b"\0" + struct.pack(f">{width}H", *samples[y * width : (y + 1) * width]) for y in range(height))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_capture_sources(spark, tmp_path):
    (tmp_path / "depth").mkdir()
    (tmp_path / "odometry.csv").write_text("timestamp, frame, x, y, z, qx, qy, qz, qw\n1.0, 0, 0, 1, 2, 0, 0, 0, 1\n")
    (tmp_path / "depth" / "000003.png").write_bytes(_png(3, 2, [1, 2, 3, 1000, 5000, 65535]))
    (tmp_path / "depth" / "000004.png").write_bytes(b"broken")
    files = capture.listing(spark, str(tmp_path))
    assert capture.tier(files).first().tier == "lidar"
    assert sorted(r.member for r in capture.missing_members(files).collect()) == ["camera_matrix.csv"]
    assert capture.odometry(spark, str(tmp_path / "odometry.csv")).first().z == 2.0
    frames = capture.rasters(spark, str(tmp_path / "depth"))
    assert {r.frame_id: r.samples for r in frames.collect()} == {3: [1, 2, 3, 1000, 5000, 65535], 4: None}
    assert capture.pixels(frames.where("samples is not null")).where("u = 1 and v = 1").first().z == 5.0


def test_photo_rooms(spark, tmp_path):
    for room, n in (("kitchen", 11), ("hall", 1)):
        (tmp_path / room).mkdir()
        for k in range(n):
            (tmp_path / room / f"{k:02d}.jpg").write_bytes(b"x")
    found = capture.photo_rooms(capture.listing(spark, str(tmp_path))).groupBy("room").count().collect()
    assert [(r.room, r["count"]) for r in found] == [("kitchen", 8)]


def test_probe_swaps_turned_sides(spark):
    text = "Duration: 00:01:02.50, start\n Stream: Video: hevc, 1920x1080, 29.97 fps, displaymatrix: rotation of -90.00 degrees\n com.apple.quicktime.model : Phone 9 \n arib-std-b67"
    row = capture.probe(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.duration, row.w, row.h, row.fps, row.model, row.hdr) == (62.5, 1080, 1920, 29.97, "Phone 9", True)


def test_broken_checkpoint_is_a_miss(spark, tmp_path):
    path = str(tmp_path / "kept")
    made = []
    compute = lambda: made.append(1) or spark.range(3)
    assert capture.checkpointed(compute, spark, path).count() == 3
    assert capture.checkpointed(compute, spark, path).count() == 3 and len(made) == 1


def test_streaming_sessions(spark, tmp_path):
    from planspark.streaming import state

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-05 00:00:00")], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = state.sessions(stream, "30 minutes").writeStream.outputMode("append").format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select * from s where user_id = 1").collect()) == [1, 2]


def test_streaming_chain(spark, tmp_path):
    from planspark.streaming import state

    spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 0, 5.0)], "capture_id long, window long, ratio double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("capture_id long, window long, ratio double").parquet(str(tmp_path / "in"))
    q = state.chained_scale(stream).writeStream.outputMode("append").format("memory").queryName("ch").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.capture_id, r.window): r.scale for r in spark.sql("select * from ch").collect()} == {(1, 0): 2.0, (1, 1): 6.0, (2, 0): 5.0}
