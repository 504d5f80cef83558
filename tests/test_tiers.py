"""A scan made here becomes a plan; the command line, the service and streamed chains."""

import json
import math
import time

import numpy as np
import pytest
from test_sources import _png

from planspark import __main__ as cli
from planspark import server
from planspark.plans import config, tiers
from planspark.sources import models, sinks


def _depth(position, yaw, width, height, focal, room):
    """Depth of a room seen from a place, and the turn of the camera."""
    u, v = np.meshgrid(np.arange(width) + 0.5 - width / 2, np.arange(height) + 0.5 - height / 2)
    ray = np.stack([u / focal, v / focal, np.ones_like(u)], -1)
    c, s = math.cos(yaw), math.sin(yaw)
    turn = np.array([[c, 0, s], [0, -1, 0], [s, 0, -c]])  # looks level; image down is world down
    world = ray @ turn.T
    best = np.full(u.shape, np.inf)
    for axis, (low, high) in enumerate(zip((0, 0, 0), room, strict=True)):
        for plane in (low, high):
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (plane - position[axis]) / world[..., axis]
            at = np.array(position) + t[..., None] * world
            ok = (t > 0.05) & np.all([(at[..., k] >= -1e-6) & (at[..., k] <= room[k] + 1e-6) for k in range(3) if k != axis], axis=0)
            best = np.where(ok & (t < best), t, best)
    return np.where(np.isfinite(best) & (best < 7), best, 0), turn


def _quaternion(m):
    k = np.array([[m[0, 0] - m[1, 1] - m[2, 2], 0, 0, 0], [m[0, 1] + m[1, 0], m[1, 1] - m[0, 0] - m[2, 2], 0, 0], [m[0, 2] + m[2, 0], m[1, 2] + m[2, 1], m[2, 2] - m[0, 0] - m[1, 1], 0], [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1], m[0, 0] + m[1, 1] + m[2, 2]]]) / 3
    return np.linalg.eigh(k, "L")[1][:, -1]


ROOM = (4.0, 2.5, 3.0)


@pytest.fixture(scope="module")
def scan(tmp_path_factory):
    folder = tmp_path_factory.mktemp("scan")
    (folder / "depth").mkdir()
    width, height, focal = 96, 96, 40.0
    lines = ["timestamp, frame, x, y, z, qx, qy, qz, qw"]
    k = 0
    for spot in ((1.0, 1.4, 1.0), (2.0, 1.4, 1.6), (3.0, 1.4, 1.0)):
        for step in range(8):
            z, turn = _depth(spot, step * math.pi / 4 + 0.1, width, height, focal, ROOM)
            (folder / "depth" / f"{k:06d}.png").write_bytes(_png(width, height, np.round(z * 1000).astype(int), [0] * height))
            lines.append(", ".join(map(str, [k / 10, k, *spot, *_quaternion(turn)])))
            k += 1
    (folder / "odometry.csv").write_text("\n".join([*lines, lines[-1].replace(f"{k - 1},", f"{k},", 1)]) + "\n")
    (folder / "camera_matrix.csv").write_text(f"{focal}, 0, {width / 2}\n0, {focal}, {height / 2}\n0, 0, 1\n")
    return folder


def test_scan_to_plan(spark, scan, tmp_path):
    settings = config.load("lite", settings=("lidar.frame_stride=1", "lidar.voxel_m=0.04", "lidar.max_depth_m=7.0"))
    plan = tiers.scan_plan(spark, str(scan), settings, scale=1.0, res=0.05, per_frame=900)
    assert sinks.problems(plan) == []
    room = max(plan["rooms"], key=lambda r: r["floor_area"]["value"])
    short, long = sorted(max(c) - min(c) for c in zip(*room["polygon"], strict=True))
    assert (short, long) == (pytest.approx(3.0, abs=0.1), pytest.approx(4.0, abs=0.1))
    assert room["floor_area"]["value"] == pytest.approx(12.0, abs=0.5) and room["ceiling_height"]["value"] == pytest.approx(2.5, abs=0.03)
    assert room["openings"] == []
    assert all(g["passed"] for g in tiers.scored(plan, {"ceiling": 2.5, "area": 12.0}, room["id"]) if g["gate"] == "ceiling")
    wall = room["walls"][0]
    (u, v), (u2, v2) = wall["start"], wall["end"]
    length = math.hypot(u2 - u, v2 - v)
    stain = [(d, room["id"], "water_stain", 0.9 - d / 10, f"f{d}", u + (u2 - u) / length * a, h, v + (v2 - v) / length * a, 0.01) for d in (1, 2) for a in np.linspace(1, 1.4, 9) for h in np.linspace(0.1, 0.4, 6)]
    rows = spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in stain], "det int, room string, class string, confidence double, frame string, x double, y double, z double, px double")
    marked = tiers.damaged(spark, plan, rows)
    assert sinks.problems(marked) == [] and len(marked["damage"]) == 1 and marked["damage"][0]["evidence_frames"] == ["f1", "f2"]
    assert [f["rule_id"] for f in marked["concealed_flags"]] == ["R-WATER-BASE"] and {s["code"] for s in marked["scope"]} == {"DRY-SEAL", "PNT-WALL", "DRY-FLOOD", "DRY-RPL"}
    sinks.write_plan(marked, tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        tiers.scan_plan(spark, str(tmp_path / "out"), settings)


def test_door_and_window_are_seen_through(spark):
    """A wall at v = 3 with a gap from 1.5 to 2.4 that is seen through to the floor, and one from 3.0 to 3.7 above a sill."""
    rng = np.random.default_rng(0)
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    walls = [("scan", 1, k, *ring[k], *ring[(k + 1) % 4], 2.0, 1.5) for k in range(4)]
    rows = []
    for a, b in ((0, 1.5), (2.4, 3.0), (3.7, 4)):
        rows += [("scan", 1.95, 1.0, x, 3 + rng.normal(0, 0.01), rng.uniform(0.3, 1.8)) for x in rng.uniform(a, b, int(4000 * (b - a)))]
    for a, b, low in ((1.5, 2.4, 0.0), (3.0, 3.7, 1.0)):
        for x in rng.uniform(a, b, 3000):
            rows.append(("scan", 1.95, 1.0, 1.95 + (x - 1.95) * 1.4, 3.8, rng.uniform(low, 2.0)))
    sights = spark.createDataFrame([tuple(v if isinstance(v, str) else float(v) for v in r) for r in rows], "capture string, cu double, cv double, pu double, pv double, h double")
    found = tiers.openings(spark.createDataFrame(walls, "capture string, room int, k int, u double, v double, u2 double, v2 double, mu double, mv double"), sights).collect()
    got = {r.kind: r for r in found}
    assert set(got) == {"door", "window"} and {r.k for r in found} == {2}
    assert got["door"].width == pytest.approx(0.9, abs=0.1) and got["door"].cu == pytest.approx(1.95, abs=0.1) and got["door"].cv == pytest.approx(3.0)
    assert got["window"].width == pytest.approx(0.7, abs=0.1) and got["window"].sill > 0.9 and got["window"].confidence == 1.0


def test_detections_become_points(spark, scan, tmp_path):
    plan = sinks.empty_plan("lidar", "x")
    views = spark.createDataFrame([("r1", f, 96, 96, 96, 96) for f in range(12)] + [("r2", 1, 96, 48, 96, 96)], "room string, frame_id int, w int, h int, depth_w int, depth_h int")
    asked = []

    def model(room, frames):
        asked.append((room, frames))
        return spark.createDataFrame([(0, "mold", 250, 250, 750, 750, 0.8, "")], models.CONTRACTS["detections"])

    get = lambda policy, m=model: tiers.detected(spark, plan, views, str(tmp_path), policy, "owlv2", m)
    assert get("replay") is None and len(plan["warnings"]) == 2
    boxes = get("replay_or_live")
    assert get("replay").count() == boxes.count() == 1 and [(r, len(f)) for r, f in asked] == [("r1", 8)]
    assert tiers.detected(spark, plan, views, str(tmp_path), "replay", "off") is None
    frames, pixels = tiers.scan_frames(spark, str(scan), 1.0)
    points = tiers.box_points(boxes, frames, pixels, (96, 96), 0.0, 0.0, 40.0).collect()
    assert len(points) == 48 * 48 and {p.frame for p in points} == {"frame 000000"}
    assert all(-0.05 < p.x < 4.05 and -0.05 < p.y < 2.55 and -0.05 < p.z < 3.05 for p in points)


def test_views_to_plan(spark, scan):
    rows = []
    for k, (spot, yaw) in enumerate(((p, y) for p in ((1.2, 1.4, 1.2), (2.8, 1.4, 1.8)) for y in np.arange(8) * math.pi / 4)):
        z, turn = _depth(spot, float(yaw), 64, 64, 27.0, ROOM)
        m = [x for i in range(3) for x in (*map(float, turn[i]), spot[i])]
        rows.append((k, *m, 27.0, 27.0, 32.0, 32.0, 64, 64, z.reshape(-1).tolist(), [1.0] * z.size))
    plan = tiers.view_plan(spark.createDataFrame(rows, models.CONTRACTS["views"]), "photos", "x", 0.05, 0.08)
    assert sinks.problems(plan) == [] and plan["rooms"]
    assert plan["rooms"][0]["floor_area"]["value"] == pytest.approx(12.0, rel=0.15)


def test_command_line(capsys, tmp_path):
    assert cli.main(["hw"]) == 0 and json.loads(capsys.readouterr().out)["profile"] in config.PROFILES
    assert cli.main(["config", "-p", "lite", "-s", "drift.method=off"]) == 0 and "method: 'off'" in capsys.readouterr().out
    assert cli.main(["config", "-s", "no.such=1"]) == 2 and cli.main(["inspect", str(tmp_path)]) == 2
    (tmp_path / "room").mkdir()
    assert cli.auto_profile({"vram_gb": 0, "apple": True, "ram_gb": 15.9}) == "mac-16gb" and cli.auto_profile({"vram_gb": 11.5, "apple": False, "ram_gb": 8}) == "cuda-16gb"


def test_service(tmp_path):
    plan = tmp_path / "plan.json"

    def make(path, out, settings):
        if not list(path.rglob("*.jpg")):
            raise ValueError("nothing there")
        plan.write_text("{}")
        plan.with_suffix(".svg").write_text("<svg/>")
        return plan

    service = server.Service(tmp_path / "jobs", make, home=tmp_path)
    body = b'--X\r\nContent-Disposition: form-data; name="f"; filename="a.jpg"\r\n\r\nxyz\r\n--X--\r\n'
    status, _, reply = service.answer("POST", "/api/jobs", "multipart/form-data; boundary=X", body)
    job = json.loads(reply)["id"]
    service.waiting.join()
    assert status == 202 and json.loads(service.answer("GET", f"/api/jobs/{job}")[2])["status"] == "done"
    assert service.answer("GET", f"/api/jobs/{job}/plan.svg")[2] == b"<svg/>" and service.answer("GET", f"/api/jobs/{job}/other")[0] == 404
    assert service.answer("POST", "/api/jobs", "multipart/form-data; boundary=X", body.replace(b"a.jpg", b"../a.jpg"))[0] == 400
    assert service.answer("POST", "/api/jobs/local", "", json.dumps({"path": "/etc"}).encode())[0] == 400
    (tmp_path / "empty").mkdir()
    time.sleep(0.01)
    failing = json.loads(service.answer("POST", "/api/jobs/local", "", json.dumps({"path": str(tmp_path / "empty")}).encode())[2])["id"]
    service.waiting.join()
    rows = json.loads(service.answer("GET", "/api/jobs")[2])
    assert [r["id"] for r in rows] == [failing, job] and rows[0]["error"] == "ValueError: nothing there"
    assert service.answer("GET", "/")[0] == 200 and json.loads(service.answer("GET", "/api/info")[2])["jobs"] == 2
    service.jobs.put("x", status="running")
    assert server.Jobs(tmp_path / "jobs").rows["x"]["status"] == "interrupted"


def test_streamed_chain(spark, tmp_path):
    from planspark.streaming import chains

    rng = np.random.default_rng(1)
    rows, want, s, r, t = [], {}, 1.0, np.eye(3), np.zeros(3)
    for w in range(5):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        own = (float(rng.uniform(0.5, 2)), q, rng.normal(size=3))
        t, s, r = s * r @ own[2] + t, s * own[0], r @ own[1]
        want[w] = s, t
        rows.append((1, w, own[0], *map(float, own[1].reshape(-1)), *map(float, own[2])))
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, chains.STEP).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(chains.STEP).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = chains.chained(stream).writeStream.outputMode("append").format("memory").queryName("chain").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {x.window: x for x in spark.sql("select * from chain").collect()}
    assert len(got) == 5 and all(got[w].s == pytest.approx(want[w][0]) and np.allclose([got[w].tx, got[w].ty, got[w].tz], want[w][1]) for w in got)


def test_commands_are_guarded(tmp_path):
    import sys

    from planspark import guard

    small = guard.guarded([sys.executable, "-c", "print('ok'); raise SystemExit(3)"], 500, 0.1, tmp_path / "log")
    assert (small["code"], small["ended"]) == (3, False) and (tmp_path / "log").read_text() == "ok\n"
    large = guard.guarded([sys.executable, "-c", "import time; x = b'x' * 300_000_000; time.sleep(60)"], 150, 0.1)
    assert large["code"] == 137 and large["peak_mb"] > 150 and large["seconds"] < 30
    lines, counts = guard.health({"a": lambda: True, "b": lambda: None, "c": lambda: False, "d": lambda: 1 / 0})
    assert counts == {"pass": 1, "warn": 1, "fail": 2} and lines[3].startswith("fail d (ZeroDivisionError")
    states = iter(["queued", "running", "done"])
    assert guard.wait_for(lambda: next(states), every=0) == "done"
    with pytest.raises(TimeoutError):
        guard.wait_for(lambda: "running", every=0, most=0)
