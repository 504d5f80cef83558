"""Sources and sinks on files made here."""

import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planspark.sources import capture, files, models, photos, records, sinks


def _tiff(f35=None, orientation=1, gps=False, model=b"Phone\0"):
    entries = [(0x0110, 2, len(model), None), (0x0112, 3, 1, struct.pack("<HH", orientation, 0)), (0x8769, 4, 1, None)] + ([(0x8825, 4, 1, struct.pack("<I", 8))] if gps else [])
    ifd = 8
    after = ifd + 2 + 12 * len(entries) + 4
    exif = after + len(model)
    own = b"".join(struct.pack("<HHI", t, k, n) + (v or struct.pack("<I", after if t == 0x0110 else exif)) for t, k, n, v in entries)
    sub = [(0x920A, 5, 1, struct.pack("<I", exif + 2 + 12 * (2 if f35 else 1) + 4))] + ([(0xA405, 3, 1, struct.pack("<HH", f35, 0))] if f35 else [])
    inner = struct.pack("<H", len(sub)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in sub) + b"\0" * 4 + struct.pack("<II", 22, 10)
    return b"II*\0" + struct.pack("<I", ifd) + struct.pack("<H", len(entries)) + own + b"\0" * 4 + model + inner


def _jpeg(w, h, tiff=None):
    app = b"" if tiff is None else b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9 + b"\xff\xd9"


def test_photo_headers():
    got = photos.header(_jpeg(4032, 3024, _tiff(13, 6, True)))
    assert (got["w"], got["h"], got["orientation"], got["f35"], got["f_mm"], got["model"], got["gps"], got["error"]) == (4032, 3024, 6, 13.0, 2.2, "Phone", True, None)
    bare = photos.header(_jpeg(10, 20))
    assert (bare["f35"], bare["orientation"], bare["gps"]) == (None, 1, False)
    for broken in (b"", b"text", b"\xff\xd8\xff\xe1\x00", _jpeg(10, 20)[:12]):
        assert photos.header(broken)["error"]


def test_proxies_carry_their_lens(tmp_path):
    for model in ("", "abc", "Phone 9"):
        for before in (_jpeg(40, 30), _jpeg(40, 30, _tiff(26, 6, True))):
            got = photos.header(photos.tagged(before, 13, 3, model))
            assert (got["w"], got["h"], got["f35"], got["orientation"], got["model"] or "", got["gps"], got["error"]) == (40, 30, 13.0, 3, model, False, None)
    photos.write_proxies(tmp_path / "room", {"a.jpg": _jpeg(40, 30)}, 13, {"area": 12.0})
    assert photos.header((tmp_path / "room" / "a.jpg").read_bytes())["f35"] == 13 and json.loads((tmp_path / "room" / "truth.json").read_text()) == {"area": 12.0}
    with pytest.raises(ValueError):
        photos.tagged(b"png", 13)


def test_rooms_of_photos(spark, tmp_path):
    for room, n in (("kitchen", 11), ("hall", 1), ("bed", 3)):
        (tmp_path / room).mkdir()
        for k in range(n):
            (tmp_path / room / f"{k:02d}.jpg").write_bytes(_jpeg(4032, 3024, _tiff(13 if room != "bed" else None, 6 if k == 0 else 1)))
    (tmp_path / "bed" / "99.jpg").write_bytes(b"broken")
    (tmp_path / "loose.jpg").write_bytes(_jpeg(10, 20))
    used, warnings = photos.rooms(photos.headers(spark, str(tmp_path)), tmp_path.name)
    assert {r.room: r["count"] for r in used.groupBy("room").count().collect()} == {"kitchen": 8, "bed": 3}
    first = used.where("room = 'kitchen' and name = '00.jpg'").first()
    assert (first.uw, first.uh) == (1440, 1920) and first.focal_px == pytest.approx(13 * 2400 / np.hypot(36, 24))
    text = {(r.room, r.text.split(" ")[0]) for r in warnings.collect()}
    assert text == {("bed", "99.jpg"), (tmp_path.name, "1"), ("hall", "1"), ("kitchen", "11"), ("bed", "no")}
    for p in list(tmp_path.iterdir()):
        if p.is_dir():
            for q in p.iterdir():
                q.unlink()
            p.rmdir()
    (tmp_path / "other.jpg").write_bytes(_jpeg(10, 20))
    used, _ = photos.rooms(photos.headers(spark, str(tmp_path)), tmp_path.name)
    assert used.count() == 2


def _png(width, height, rows, kinds):
    step = 2
    data = np.asarray(rows, ">u2").view(np.uint8).reshape(height, -1).astype(int)
    raw, above = b"", np.zeros(width * step, int)
    for y in range(height):
        own, left, corner = data[y], np.r_[np.zeros(step, int), data[y][:-step]], np.r_[np.zeros(step, int), above[:-step]]
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [np.zeros_like(own), left, above, (left + above) // 2, near][kinds[y]]
        raw += bytes([kinds[y]]) + ((own - guess) & 255).astype(np.uint8).tobytes()
        above = own
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_all_row_filters():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 65536, (10, 7))
    w, h, got = capture.decode_png(_png(7, 10, rows, [0, 1, 2, 3, 4] * 2))
    assert (w, h, got) == (7, 10, rows.reshape(-1).tolist())


def test_intrinsics(spark, tmp_path):
    (tmp_path / "camera_matrix.csv").write_text("1500, 0, 960\n0, 1510.0, 720\n\n0, 0, 1\n")
    r = capture.intrinsics(spark, str(tmp_path / "camera_matrix.csv"), 0.1).first()
    assert (r.fx, r.fy, r.cx, r.cy) == (150.0, 151.0, 96.0, 72.0)


def test_archives_and_uploads(tmp_path):
    archive = tmp_path / "scan.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for name in ("outer/inner/odometry.csv", "outer/inner/depth/000000.png", "__MACOSX/x"):
            z.writestr(name, "x")
    found = files.resolve(archive, tmp_path / "work")
    assert found.name == "inner" and files.tier_of(found) == "lidar"
    rooms = tmp_path / "photos" / "kitchen"
    rooms.mkdir(parents=True)
    (rooms / "a.JPG").write_bytes(b"x")
    assert files.resolve(tmp_path / "photos", tmp_path) == tmp_path / "photos" and files.tier_of(tmp_path / "photos") == "photos"
    film = tmp_path / "walk" / "one.MOV"
    film.parent.mkdir()
    film.write_bytes(b"x")
    assert files.tier_of(files.resolve(film.parent, tmp_path)) == "video"
    with pytest.raises(ValueError):
        files.tier_of(tmp_path / "nothing")
    for bad in ("../x", "/etc/x", "a/../../b", "c:\\x", ""):
        with pytest.raises(ValueError):
            files.safe_parts(bad)
    upload = tmp_path / "upload"
    with pytest.raises(ValueError):
        files.store_upload(upload, {"a.jpg": b"x", "../b.jpg": b"x"})
    assert not upload.exists()
    files.store_upload(upload, {"a.jpg": b"x", "b.jpg": b"y"})
    assert files.locate(upload) == (upload, "photos") and len(list((upload / "room1").iterdir())) == 2
    files.store_upload(tmp_path / "up2", {"in/scan.zip": archive.read_bytes()})
    place, tier = files.locate(tmp_path / "up2")
    assert tier == "lidar" and place.name == "inner"


def test_release_refuses_places(tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "a.jpg").write_bytes(_jpeg(4, 3, _tiff(13)))
    has = lambda p: bool(photos.header(p.read_bytes())["gps"])
    made = files.release({"set": tmp_path / "set"}, tmp_path / "out", "v1", has)
    assert made["assets"]["set.zip"]["files"] == 1 and files.fetched(made, tmp_path / "out") == []
    (tmp_path / "out" / "set.zip").write_bytes(b"other")
    assert files.fetched(made, tmp_path / "out") == ["set.zip"]
    (tmp_path / "set" / "b.jpg").write_bytes(_jpeg(4, 3, _tiff(13, gps=True)))
    with pytest.raises(ValueError):
        files.release({"set": tmp_path / "set"}, tmp_path / "out2", "v1", has)
    assert not (tmp_path / "out2").exists()


def test_records(spark, tmp_path):
    pose = np.eye(4).tolist()
    (tmp_path / "s.json").write_text(json.dumps({"K": [[1, 0, 0]], "pieces": [1], "all": [{"c2w": {"f1": pose}, "points": [[1, 2, 3]], "obs": {"f1": {"uv": [[5, 6]], "idx": [0]}}}]}))
    got = records.structure(spark, str(tmp_path / "s.json"))
    assert got["poses"].first().m11 == 1 and got["points"].first().z == 3 and tuple(got["seen"].first()) == (0, "f1", 0, 5.0, 6.0)
    (tmp_path / "l.json").write_text(json.dumps([{"a": "x", "pa": 0, "b": "y", "pb": 1, "xa": [[1, 2]], "xb": [[3, 4]], "n": 3}, {"a": "x", "pa": 1, "b": "z", "pb": 1, "xa": [], "xb": [], "n": 9}]))
    assert [r.n for r in records.links(spark, str(tmp_path / "l.json")).collect()] == [9, 3]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "abc.json").write_text(json.dumps({"model": "m", "detections": [{"image": 0, "class": "mold", "x0": 1, "y0": 2, "x1": 3, "y1": 4, "confidence": 0.5, "note": ""}]}))
    assert records.detections(spark, str(tmp_path / "d")).first().key == "abc"
    with pytest.raises(FileNotFoundError):
        records.replayed(tmp_path / "none.json", "replay", lambda: b"")
    asked = []
    live = lambda: asked.append(1) or b"answer"
    assert [records.replayed(tmp_path / "kept.json", p, live) for p in ("replay_or_live", "replay_or_live", "replay", "live")] == [b"answer"] * 4 and len(asked) == 2
    rule = "concealed_rules:\n - {id: R1, when: {class: crack, min_length_m: 0.6}, flag: 'a\n   b'}\nscope_rules:\n - {id: S1, when: {class: hole}, items: [{code: A, qty: q, margin: 0.1}, {code: B, qty: r}]}"
    rows = records.rules(spark, rule).orderBy("kind", "item_ord").collect()
    assert [(r.rule_id, r.code, r.margin, r.flag) for r in rows] == [("R1", None, 0.0, "a b"), ("S1", "A", 0.1, None), ("S1", "B", 0.0, None)]
    tape = "space_id: home\nrooms:\n - {id: r, ceiling_height_cm: [240, null, 242], walls: [{id: w1, length_cm: [400]}, {id: w2, length_cm: [300, 302]}, {id: w3, length_cm: [402]}, {id: w4, length_cm: [301]}], openings: [{id: o, width_cm: [null]}]}"
    read = records.truth(spark, tape)
    assert read.where("kind = 'ceiling'").first().metres == 2.41 and read.where("kind = 'opening'").first().metres is None
    size = records.sizes(read).first()
    assert (size.short, size.long) == (pytest.approx(3.01), pytest.approx(4.01))
    assert records.ranges(spark, "capture: c\nrooms: {hall: [[1, 5], [9, 12]]}").count() == 2
    np.savez(tmp_path / "gt.npz", depth=np.ones((2, 3)), other=np.zeros(1))
    (tmp_path / "bad.npz").write_bytes(b"broken")
    rows = {r.path.rsplit("/")[-1]: r for r in records.arrays(spark, str(tmp_path), ["depth"]).collect()}
    assert rows["gt.npz"].shape == [2, 3] and rows["bad.npz"].name is None
    records.write_matches(tmp_path / "db", {1: np.zeros((3, 2)), 2: np.zeros((3, 2))}, {(2, 1): np.array([[0, 2], [1, 1]])})
    assert [tuple(r) for r in records.read_matches(spark, tmp_path / "db").collect()] == [(1, 2, 2, 0), (1, 2, 1, 1)]


def test_bundles_and_results(spark, tmp_path):
    records.write_bundle(tmp_path / "b", "c1", {"s1": {"depth": np.ones((1, 2, 3)), "K": np.eye(3)}, "s2": {"depth": np.zeros((1, 1, 1))}})
    got = {(r.set, r.name): r.shape for r in records.bundle(spark, str(tmp_path / "b")).collect()}
    assert got == {("s1", "depth"): [1, 2, 3], ("s1", "K"): [3, 3], ("s2", "depth"): [1, 1, 1]}
    path = sinks.write_results([{"a": 1}], tmp_path / "r" / "out.json", capture="c1")
    assert json.loads(path.read_text()) == {"capture": "c1", "rows": [{"a": 1}]}


def test_model_results_are_replayed(spark, tmp_path):
    rows = spark.createDataFrame([(0, 2, 1, [1.0, 2.0])], models.CONTRACTS["depth"])
    made = []
    model = lambda: made.append(1) or rows
    key = models.key_of("depth", {"side": 504}, ["a.jpg"])
    assert key != models.key_of("depth", {"side": 518}, ["a.jpg"])
    get = lambda policy, m=model: models.result(spark, str(tmp_path), "depth", key, policy, m)
    with pytest.raises(FileNotFoundError):
        get("replay")
    assert get("replay_or_live").count() == 1 and get("replay_or_live").count() == 1 and get("replay").count() == 1 and len(made) == 1
    assert get("live").first().depth == [1.0, 2.0] and len(made) == 2
    with pytest.raises(TypeError):
        models.conforms(rows.drop("depth"), "depth")


def _plan():
    m = lambda v, u="m": {"value": v, "lo": v - 0.1, "hi": v + 0.1, "unit": u, "coverage": 0.9}
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]]
    walls = [{"id": f"r1.w{i + 1}", "start": ring[i], "end": ring[(i + 1) % 4], "length": m(4.0 if i % 2 == 0 else 3.0)} for i in range(4)]
    door = {"id": "r1.o1", "wall_id": "r1.w1", "type": "door", "width": m(0.9), "offset_along_wall": m(1.0), "sill_height": m(0.0), "connects_to": None}
    plan = sinks.empty_plan("lidar", "x")
    plan["rooms"] = [{"id": "r1", "label": "room <1>", "polygon": ring, "walls": walls, "openings": [door, {**door, "wall_id": "r9.w1"}], "ceiling_height": None, "floor_area": m(12.0, "m2"), "perimeter": m(14.0)}]
    plan["property"] = {"footprint_area": m(12.0, "m2")}
    plan["damage"] = [{"id": "D1", "surface_id": "r1.w2", "class": "water_stain", "confidence": 0.5, "polygon_on_surface": [[0.5, 0], [1.0, 0]]}, {"id": "D2", "surface_id": "r1.floor", "class": "mold", "confidence": 0.5}]
    plan["warnings"] = ["ceiling not observed"]
    return plan


def test_plan_is_checked_drawn_and_written(tmp_path):
    import xml.etree.ElementTree as ET

    plan = _plan()
    assert sinks.problems(plan) == []
    path = sinks.write_plan(plan, tmp_path / "out", "a: 1")
    assert json.loads(path.read_text()) == plan and sorted(p.name for p in path.parent.iterdir()) == ["config.resolved.yaml", "plan.json", "plan.svg"]
    root = ET.fromstring(sinks.drawing(plan))
    texts = [e.text for e in root.iter() if e.tag.endswith("text")]
    assert {"4.00", "door 0.90", "room <1>", "12.00 ±0.10 m²", "ceiling n/a", "D1 water stain", "D2 mold on floor"} <= set(texts) and sum(t == "door 0.90" for t in texts) == 1
    assert sinks.summary(plan) == ["r1: 12.00 m2, 4 walls, ceiling not observed", "! ceiling not observed"]
    for wrong in ({"rooms": None}, {"warnings": [1]}, {"rooms": [{**plan["rooms"][0], "floor_area": {"value": "x"}}]}):
        with pytest.raises(ValueError):
            sinks.write_plan({**plan, **wrong}, tmp_path / "bad")
    assert not (tmp_path / "bad").exists()


def test_empty_plan_is_drawn():
    assert "<svg" in sinks.drawing(sinks.empty_plan("photos", "x"))
    assert F is not None
