"""Captures to plans: a scan's folder becomes rooms with measured walls, areas and ceilings, their openings, damage and scope.

Clouds, cells and aggregates stay in DataFrames; what is collected is as large as a plan (rooms, walls, openings).
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planspark.functions import scalars as X
from planspark.operators import audits, damage, geometry, graph, points, rooms, rules, walls
from planspark.operators.runs import open_runs
from planspark.operators.storage import written
from planspark.sources import capture, sinks

# Errors of a surface's place (metres) and of the scale, by tier.
ERRORS = {"lidar": (0.01, 0.0), "video": (0.02, 0.04), "photos": (0.03, 0.05)}
KEY = "capture"


def scan_frames(spark: SparkSession, folder: str, scale: float = 256 / 1920) -> tuple[DataFrame, DataFrame]:
    """(frames with poses, pixels (frame_id, u, v, z, conf)) of a scan's folder; without confidence all pixels count."""
    frames = capture.odometry(spark, f"{folder}/odometry.csv").withColumnRenamed("frame", "frame_id")
    turn = X.rotation(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    frames = frames.select("frame_id", *[F.col(c).alias(f"t{c}") for c in "xyz"], *[r.alias(f"r{i}") for i, r in enumerate(turn)])
    pixels = capture.pixels(capture.rasters(spark, f"{folder}/depth"))
    members = {r.folder for r in capture.listing(spark, folder).select("folder").distinct().collect()}
    if "confidence" in members:
        conf = capture.pixels(capture.rasters(spark, f"{folder}/confidence"), 1.0).withColumnRenamed("z", "conf")
        pixels = pixels.join(conf, ["frame_id", "u", "v"])
    else:
        pixels = pixels.withColumn("conf", F.lit(2.0))
    k = capture.intrinsics(spark, f"{folder}/camera_matrix.csv", scale).first()
    return frames, pixels.select("frame_id", "u", "v", "conf", *[e.alias(c) for c, e in zip("abc", X.camera_point(F.col("u"), F.col("v"), F.col("z"), k.fx, k.fy, k.cx, k.cy), strict=True)])


def scan_cloud(spark: SparkSession, folder: str, settings: dict[str, Any], scale: float = 256 / 1920) -> dict[str, DataFrame]:
    """``cloud`` (x, y up, z), ``rays`` and ``cameras`` of a scan: confident pixels of every k-th frame, averaged by voxel."""
    own = settings["lidar"]
    frames, pixels = scan_frames(spark, folder, scale)
    frames = points.strided(frames.withColumn(KEY, F.lit("scan")), own["frame_stride"], ["frame_id"], [KEY])
    valid = pixels.where(points.valid_pixel(F.col("conf"), F.col("c"), own["min_confidence"], own["max_depth_m"]))
    at = X.transform([F.col(f"r{i}") for i in range(9)], [F.col(f"t{c}") for c in "xyz"], [F.col(c) for c in "abc"])
    world = written(valid.join(F.broadcast(frames) if frames.count() < 100_000 else frames, "frame_id").select(KEY, "frame_id", "tx", "tz", *[e.alias(c) for c, e in zip("xyz", at, strict=True)]))
    cloud = points.voxel_fuse(world, own["voxel_m"], 2, [KEY]).select(KEY, "x", "y", "z")
    cameras = frames.select(KEY, F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    return {"cloud": written(cloud), "world": world, "cameras": cameras}


def _measure(value: float, sigma: float, unit: str) -> dict[str, Any]:
    return {"value": round(value, 4), "lo": round(value - X.Z90 * sigma, 4), "hi": round(value + X.Z90 * sigma, 4), "unit": unit, "coverage": 0.9}


def _floor(cloud: DataFrame, eye: float) -> tuple[float, float]:
    level = points.floor_level(cloud, eye, [KEY]).select(KEY, ((F.col("bin") + 0.5) * 0.01).alias("guess"))
    row = points.refined_level(cloud, level, [KEY]).first()
    return row["level"], row["sigma"]


def openings(found: DataFrame, sights: DataFrame, slot: float = 0.05, tolerance: float = 0.08, beyond: float = 0.25) -> DataFrame:
    """Openings (room, wall, offset, width, kind, confidence, sill, cu, cv) in walls (room, k, u, v, u2, v2, mu, mv).

    ``sights`` (cu, cv, pu, pv, h) are points with the camera that saw them. A slot of a wall is open if three of them lie
    beyond it and it holds little wall; slots are the buckets of the aggregate, and a wall meets its own sights only.
    """
    length = F.hypot(F.col("u2") - F.col("u"), F.col("v2") - F.col("v"))
    rows = found.withColumn("len", length).where("len >= 65e-2").withColumns({"du": (F.col("u2") - F.col("u")) / F.col("len"), "dv": (F.col("v2") - F.col("v")) / F.col("len")})
    side = F.when((F.col("mu") - F.col("u")) * -F.col("dv") + (F.col("mv") - F.col("v")) * F.col("du") > 0, -1.0).otherwise(1.0)
    rows = rows.withColumn("side", side)
    met = sights.join(F.broadcast(rows) if rows.count() < 10_000 else rows, KEY)
    along = (F.col("pu") - F.col("u")) * F.col("du") + (F.col("pv") - F.col("v")) * F.col("dv")
    across = ((F.col("pu") - F.col("u")) * -F.col("dv") + (F.col("pv") - F.col("v")) * F.col("du")) * F.col("side")
    s, t = geometry.crossing(F.col("cu"), F.col("cv"), F.col("pu"), F.col("pv"), F.col("u"), F.col("v"), F.col("u2"), F.col("v2"))
    wall = (F.abs(across) < tolerance) & (along > 0) & (along < F.col("len")) & (F.col("h") > 0.3) & (F.col("h") < 1.8)
    through = (across > beyond) & (s > 0) & (s < 1) & (t >= 0) & (t <= 1)
    place = F.when(through, F.floor(t * F.col("len") / slot)).when(wall, F.floor(along / slot)).cast("long")
    slots = met.withColumn("slot", place).where("slot is not null").groupBy(KEY, "room", "k", "slot").agg(F.count_if(wall).alias("wall"), F.count_if(through).alias("seen"), F.min(F.when(through, F.col("h"))).alias("sill"))
    usual = slots.where("wall > 0").groupBy(KEY, "room", "k").agg(F.percentile("wall", F.lit(0.75)).alias("usual"))
    every = rows.select(KEY, "room", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("len") / slot) - 1)).alias("slot"))
    full = every.join(slots, [KEY, "room", "k", "slot"], "left").join(usual, [KEY, "room", "k"], "left")
    few = F.coalesce("wall", F.lit(0)) < 0.15 * F.coalesce("usual", F.lit(1.0))
    marked = full.withColumn("open", few & (F.coalesce("seen", F.lit(0)) >= 3))
    runs = open_runs(marked, [KEY, "room", "k"], slot, 0.55, 2.4)
    support = runs.drop("sill").join(marked.drop("sill"), [KEY, "room", "k"]).where((F.col("slot") * slot >= F.col("offset") - 1e-9) & (F.col("slot") * slot < F.col("offset") + F.col("width") - 1e-9))
    counted = support.groupBy(KEY, "room", "k", "offset").agg(F.sum(F.coalesce("seen", F.lit(0))).alias("support"))
    named = audits.opening_kinds(runs.join(counted, [KEY, "room", "k", "offset"]).drop("kind").withColumn("seen", F.lit(True)))
    middle = F.col("offset") + F.col("width") / 2
    return named.join(rows.select(KEY, "room", "k", "u", "v", "du", "dv"), [KEY, "room", "k"]).withColumns({"cu": F.col("u") + F.col("du") * middle, "cv": F.col("v") + F.col("dv") * middle}).drop("u", "v", "du", "dv")


def rooms_of(parts: dict[str, DataFrame], tier: str, voxel: float, source: str, res: float = 0.02, carve: bool = True, per_frame: int = 150) -> dict[str, Any]:
    """The plan of a cloud (x, y, z), its world points with cameras, and camera places."""
    absolute, relative = ERRORS[tier]
    cloud, world, cameras = parts["cloud"], parts["world"], parts["cameras"]
    plan = sinks.empty_plan(tier, source)
    eye = cameras.agg(F.median("y")).first()[0]
    floor, floor_sigma = _floor(cloud, eye)
    plausible = 1.0 <= eye - floor <= 1.95
    high = cloud.withColumn("y", F.col("y") - floor)
    degree = walls.dominant_angle(high.where("y > 3e-1 and y < 2e0"), KEY).first()["degree"]
    a = math.radians(degree)
    turned = lambda df, x, z, u="x", v="z": df.withColumns({u: F.lit(math.cos(a)) * F.col(x) + F.lit(math.sin(a)) * F.col(z), v: F.lit(math.cos(a)) * F.col(z) - F.lit(math.sin(a)) * F.col(x)})
    flat = written(turned(high, "x", "z"))
    sights = turned(turned(world.withColumn("h", F.col("y") - floor), "x", "z", "pu", "pv"), "tx", "tz", "cu", "cv")
    band = sights.where("h > 3e-1 and h < 18e-1")
    rays = points.capped(band.select(KEY, "frame_id", F.col("cu").alias("x0"), F.col("cv").alias("z0"), F.col("pu").alias("x1"), F.col("pv").alias("z1")), per_frame, [KEY, "frame_id"], ["x1", "z1"])
    seen = turned(cameras, "x", "z")
    cells = rooms.maps(flat, rays, seen, KEY, res, carve)
    interior = written(cells["interior"])
    track = seen.select(KEY, X.cell(F.col("x"), res).alias("col"), X.cell(F.col("z"), res).alias("row"))
    split = written(rooms.split(interior, track, KEY, res))
    group = [KEY, "room"]
    edges = walls.rectilinear(geometry.edges(rooms.outlines(split, KEY, res), group), group)
    middle = split.groupBy(*group).agg(((F.avg("col") + 0.5) * res).alias("mu"), ((F.avg("row") + 0.5) * res).alias("mv"))
    inward = F.when(F.when(F.col("axis") == 0, F.col("mu")).otherwise(F.col("mv")) > F.col("c"), 1.0).otherwise(-1.0)
    signed = edges.join(middle, group).withColumn("sign", inward).drop("mu", "mv")
    near = flat.where("y > 3e-1 and y < 2e0").select(KEY, F.col("x").alias("u"), F.col("z").alias("v"))
    fit = written(walls.fitted(signed, near.join(split.select(*group).distinct(), KEY), group))
    corner = written(walls.corners(fit, group))
    sigma = fit.select(*group, F.col("k").alias("i"), "sigma")
    ring = corner.join(sigma, [*group, "i"], "left").withColumn("sigma", F.coalesce("sigma", F.lit(0.05)))
    closed = corner.groupBy(*group).count().where("count >= 3").select(*group)
    records = written(walls.records(ring.join(closed, group), group, absolute, relative))
    inside = geometry.inside_polygon(flat.select(KEY, F.col("x").alias("pu"), F.col("z").alias("pv"), "y").join(closed, KEY), geometry.edges(corner.join(closed, group), group), group, ["pu", "pv", "y"])
    levels = {r.room: r for r in walls.ceilings(inside.withColumnRenamed("y", "h"), records.select(*group, F.col("floor_area.value").alias("area")), group, voxel).collect()}
    outline = geometry.edges(corner.join(closed, group), group).withColumnRenamed("i", "k").join(middle, group)
    holes = written(openings(outline, sights.select(KEY, "cu", "cv", "pu", "pv", "h")))
    doors: dict[int, list] = {}
    for o in holes.orderBy("room", "k", "offset").collect():
        doors.setdefault(o.room, []).append(o)
    for r in records.orderBy("room").collect():
        rid = f"r{r.room}"
        found = [{"id": f"{rid}.w{w.i + 1}", "start": [round(c, 4) for c in w.start], "end": [round(c, 4) for c in w.end], "length": w.length.asDict()} for w in r.walls]
        room: dict[str, Any] = {"id": rid, "label": f"room {r.room}", "polygon": [w["start"] for w in found], "walls": found, "openings": [], "floor_area": r.floor_area.asDict(), "perimeter": r.perimeter.asDict()}
        for j, o in enumerate(doors.get(r.room, [])):
            width = math.sqrt(2 * (0.025 + absolute) ** 2 + (relative * o.width) ** 2)
            room["openings"].append({"id": f"{rid}.o{j + 1}", "wall_id": f"{rid}.w{o.k + 1}", "type": o.kind, "width": _measure(o.width, width, "m"), "offset_along_wall": _measure(o.offset, width, "m"), "sill_height": _measure(o.sill, 0.05, "m"), "connects_to": None, "detection_confidence": o.confidence, "centre_plan": [round(o.cu, 3), round(o.cv, 3)]})
        top = levels.get(r.room)
        if not plausible:
            plan["warnings"].append(f"{rid}: the camera is {eye - floor:.2f} m above the floor found, so no ceiling is reported")
        if not plausible or top is None or top.level is None:
            room["ceiling_height"] = None
            plan["warnings"].append(f"{rid}: ceiling not observed well enough; no value")
        else:
            room["ceiling_height"] = _measure(top.level, math.sqrt(top.sigma**2 + floor_sigma**2 + 2 * absolute**2 + (relative * top.level) ** 2), "m")
            if top.second is not None:
                plan["warnings"].append(f"{rid}: a second ceiling at {top.second:.2f} m beside the one at {top.level:.2f} m")
        plan["rooms"].append(room)
    plan["adjacency"] = _adjacent(plan["rooms"], rooms.passages(split, interior, KEY) if len(plan["rooms"]) > 1 else None)
    total = sum(r["floor_area"]["value"] for r in plan["rooms"])
    spread = math.sqrt(sum(((r["floor_area"]["hi"] - r["floor_area"]["lo"]) / (2 * X.Z90)) ** 2 for r in plan["rooms"]))
    plan["property"] = {"footprint_area": _measure(total, spread, "m2")}
    if not plan["rooms"]:
        spark = cloud.sparkSession
        plan["warnings"].insert(0, spark.range(1).select(audits.empty_hint(F.lit(tier), F.lit(0))).first()[0])
    return plan


def _adjacent(found: list[dict[str, Any]], through: DataFrame | None, near: float = 0.6) -> list[dict[str, str]]:
    """Rooms that meet: by the closest pair of their doors, or else by a passage."""
    out, passages = [], {(f"r{r.a}", f"r{r.b}") for r in through.collect()} if through is not None else set()
    for i, a in enumerate(found):
        for b in found[i + 1 :]:
            pairs = [(math.dist(p["centre_plan"], q["centre_plan"]), p, q) for p in a["openings"] for q in b["openings"] if "window" not in (p["type"], q["type"])]
            best = min(pairs, key=lambda x: x[0], default=None)
            if best and best[0] < near:
                best[1]["connects_to"], best[2]["connects_to"] = b["id"], a["id"]
                out.append({"a": a["id"], "b": b["id"], "via": best[1]["id"]})
            elif (a["id"], b["id"]) in passages:
                out.append({"a": a["id"], "b": b["id"], "via": "open passage"})
    return out


def box_points(boxes: DataFrame, frames: DataFrame, pixels: DataFrame, size: tuple[int, int], floor: float, degree: float, focal: float) -> DataFrame:
    """Rows for ``damaged`` of boxes (det, room, class, confidence, frame_id, x0, y0, x1, y1 on a grid of 1000) in a scan's
    frames: the pixels of each box, as points in plan coordinates."""
    w, h = size
    at = lambda c, n: F.round(F.col(c) / 1000.0 * n)
    met = pixels.join(F.broadcast(boxes) if boxes.count() < 10_000 else boxes, "frame_id").where((F.col("u") >= at("x0", w)) & (F.col("u") < at("x1", w)) & (F.col("v") >= at("y0", h)) & (F.col("v") < at("y1", h)) & (F.col("c") > 0.2) & (F.col("c") < 8.0))
    x, y, z = X.transform([F.col(f"r{i}") for i in range(9)], [F.col(f"t{c}") for c in "xyz"], [F.col(c) for c in "abc"])
    cos, sin = math.cos(math.radians(degree)), math.sin(math.radians(degree))
    return met.join(frames, "frame_id").select("det", "room", "class", "confidence", F.format_string("frame %06d", "frame_id").alias("frame"), (cos * x + sin * z).alias("x"), (y - floor).alias("y"), (cos * z - sin * x).alias("z"), (F.col("c") / focal).alias("px"))


def detected(spark: SparkSession, plan: dict[str, Any], views: DataFrame, cache: str, policy: str, backend: str, model=None, most: int = 8) -> DataFrame | None:
    """Boxes of the views (room, frame_id, w, h, depth_w, depth_h) of each room, from recorded or live detections.

    Up to ``most`` evenly spaced views of a room are looked at. Views whose depth has another shape are left out, and a
    detector without records or model is switched off; both with a warning in the plan.
    """
    from planspark.operators.runs import even_picks
    from planspark.sources import models

    if backend == "off":
        return None
    picked = even_picks(views, most, ["room"], ["frame_id"])
    fits = damage.same_shape(F.col("w"), F.col("h"), F.col("depth_w"), F.col("depth_h"))
    for r in picked.where(~fits).select("room").distinct().orderBy("room").collect():
        plan["warnings"].append(f"{r.room}: depth and image differ in shape; damage skipped")
    found = None
    good = picked.where(fits).select("room", "frame_id", (F.row_number().over(Window.partitionBy("room").orderBy("frame_id")) - 1).alias("image"))
    for r in good.groupBy("room").agg(F.sort_array(F.collect_list("frame_id")).alias("frames")).orderBy("room").collect():
        key = models.key_of("detections", {"backend": backend}, [r.room, *map(str, r.frames)])
        try:
            own = models.result(spark, cache, "detections", key, policy, None if model is None else (lambda r=r: model(r.room, list(r.frames))))
        except (FileNotFoundError, ValueError, ImportError) as e:
            plan["warnings"].append(f"damage: {backend} is not available for {r.room} ({e}); nothing is reported")
            continue
        own = own.withColumn("room", F.lit(r.room))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return None
    named = found.join(good, ["room", "image"])
    return named.select(F.row_number().over(Window.orderBy("room", "frame_id", F.desc("confidence"), "x0", "y0")).alias("det"), "room", "class", "confidence", "frame_id", "x0", "y0", "x1", "y1")


def damaged(spark: SparkSession, plan: dict[str, Any], detections: DataFrame, absolute: float = 0.01, relative: float = 0.0) -> dict[str, Any]:
    """The plan with damage regions, flags and scope out of detections.

    ``detections`` holds a row a pixel point: (det, room, class, confidence, frame, x, y above the floor, z, px) in plan
    coordinates, with a pixel's footprint. Views of one stain become one region; the most confident gives its shape.
    """
    if not plan["rooms"]:
        return plan
    table = [(r["id"], (r.get("ceiling_height") or {}).get("value"), [(w["id"], w["start"][0], w["start"][1], w["end"][0], w["end"][1]) for w in r["walls"]]) for r in plan["rooms"]]
    shape = "room string, ceiling double, walls array<struct<wall:string,ax:double,az:double,bx:double,bz:double>>"
    named = detections.groupBy("det").agg(*[F.first(c).alias(c) for c in ("room", "class", "confidence", "frame", "px")])
    rooms_ = named.select("det", "room").join(F.broadcast(spark.createDataFrame(table, shape)), "room")
    region = damage.projected(detections.select("det", "x", "y", "z"), rooms_, "det").join(named, "det")
    at = lambda i, j: F.get(F.get("polygon_on_surface", F.lit(i)), F.lit(j))
    boxes = region.select("room", "surface_id", "class", F.col("det").alias("box_id"), at(0, 0).alias("x0"), at(0, 1).alias("y0"), at(2, 0).alias("x1"), at(2, 1).alias("y1"), F.col("confidence").alias("score"), F.array("frame").alias("evidence"))
    merged = graph.merge_views(boxes, ["room", "surface_id", "class"]).select(F.col("box_id").alias("det"), F.col("evidence").alias("frames"))
    sized = damage.measured(merged.join(region, "det"), absolute, relative, F.lit(1.0), F.col("px")).withColumn("number", F.row_number().over(Window.partitionBy("room").orderBy(F.desc("confidence"), "det")))
    rows = written(sized)
    by_room = {r["id"]: r for r in plan["rooms"]}
    for r in rows.orderBy("room", "number").collect():
        plan["damage"].append({"id": f"D{len(plan['damage']) + 1}", "surface_id": r.surface_id, "class": r["class"], "polygon_on_surface": [list(p) for p in r.polygon_on_surface], "area": r.area_m2.asDict(), "extent_w": r.extent_w.asDict(), "extent_h": r.extent_h.asDict(), "confidence": round(r.confidence, 3), "evidence_frames": list(r.frames), "_room": r.room, "_kind": r.kind, "_bottom": r.bottom})
    flat = []
    for k, x in enumerate(plan["damage"]):
        own = by_room[x.pop("_room")]
        wall = next((w["length"]["value"] for w in own["walls"] if w["id"] == x["surface_id"]), None)
        top = own.get("ceiling_height") or {}
        flat.append((1, k, x["class"], x.pop("_kind"), x["surface_id"], x.pop("_bottom"), max(x["extent_w"]["value"], x["extent_h"]["value"]), x["area"]["value"], wall, top.get("value"), own["floor_area"]["value"]))
    table_ = spark.createDataFrame(flat, "plan int, d_ord int, class string, surface string, surface_id string, bottom double, length double, area double, wall_length double, ceiling double, floor_area double")
    number = lambda text: int(text[1:])
    flags = sorted(rules.concealed_flags(table_, ["plan"]).collect(), key=lambda f: number(f.flag_id))
    plan["concealed_flags"] = [{"id": f.flag_id, "surface_id": f.surface_id, "rule_id": f.rule_id, "triggered_by": [f"D{f.d_ord + 1}"]} for f in flags]
    items = sorted(rules.scope_items(table_, ["plan"]).collect(), key=lambda s: number(s.item_id))
    plan["scope"] = [{"id": s.item_id, "surface_id": s.surface_id, "code": s.code, "quantity": {"value": s.value, "lo": s.lo, "hi": s.hi, "unit": "", "coverage": 0.9}, "source": [f"D{s.d_ord + 1}", s.rule_id]} for s in items]
    return plan


def scan_plan(spark: SparkSession, folder: str, settings: dict[str, Any], scale: float = 256 / 1920, res: float = 0.02, per_frame: int = 150) -> dict[str, Any]:
    """The plan of a scan's folder; ``per_frame`` rays of a frame carve its interior."""
    if missing := [r.member for r in capture.missing_members(capture.listing(spark, folder)).collect()]:
        raise FileNotFoundError(f"{folder} is no scan: {', '.join(sorted(missing))} missing")
    parts = scan_cloud(spark, folder, settings, scale)
    return rooms_of(parts, "lidar", settings["lidar"]["voxel_m"], folder, res, per_frame=per_frame)


def view_plan(views: DataFrame, tier: str, source: str, voxel: float = 0.03, res: float = 0.02) -> dict[str, Any]:
    """The plan of views with depth (``views`` of the model contract): confident pixels, outlined by the observed walls.

    Views must be metric and upright; single pixels count, as views are few.
    """
    at = X.transform([F.col(f"m{i}{j}") for i in range(3) for j in range(3)], [F.col(f"m{i}3") for i in range(3)], X.camera_point(F.col("u"), F.col("v"), F.col("d"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy")))
    pixels = views.withColumn(KEY, F.lit("views")).select("*", F.posexplode(F.arrays_zip("depth", "conf")).alias("i", "p")).withColumns({"u": F.col("i") % F.col("width"), "v": F.floor(F.col("i") / F.col("width")), "d": F.col("p.depth")})
    sure = pixels.where("d > 2e-1 and d < 8e0").where(F.col("p.conf") >= pixels.agg(F.percentile("p.conf", F.lit(0.3))).scalar())
    world = written(sure.select(KEY, F.col("view").alias("frame_id"), F.col("m03").alias("tx"), F.col("m23").alias("tz"), *[e.alias(c) for c, e in zip("xyz", at, strict=True)]))
    cameras = views.select(F.lit("views").alias(KEY), F.col("m03").alias("x"), F.col("m13").alias("y"), F.col("m23").alias("z"))
    cloud = written(points.voxel_fuse(world, voxel, 1, [KEY]).select(KEY, "x", "y", "z"))
    return rooms_of({"cloud": cloud, "world": world, "cameras": cameras}, tier, voxel, source, res, carve=False)


def scored(plan: dict[str, Any], truth: dict[str, float], room: str) -> list[dict[str, Any]]:
    """Gates of one room of a plan against tape (short, long, area, ceiling): a room that is not there fails."""
    own = next((r for r in plan["rooms"] if room in (r["id"], r["label"])), plan["rooms"][0] if len(plan["rooms"]) == 1 else None)
    if own is None:
        return [{"gate": "room found", "passed": False}]
    from planspark.operators import scoring

    tier = plan["capture"]["tier"]
    short, long = sorted(max(c) - min(c) for c in zip(*own["polygon"], strict=True))
    high = own.get("ceiling_height") or {}
    rows = [("short", short, scoring.WALL_TOLERANCE[tier]), ("long", long, scoring.WALL_TOLERANCE[tier]), ("area", own["floor_area"]["value"], scoring.AREA_TOLERANCE[tier]), ("ceiling", high.get("value"), None)]
    out = []
    for name, value, share in rows:
        if name in truth:
            limit = scoring.CEILING_TOLERANCE if share is None else max(share * truth[name], scoring.LEAST_WALL_TOLERANCE if tier == "lidar" and name in ("short", "long") else 0.0)
            out.append({"gate": name, "value": value, "truth": truth[name], "passed": value is not None and abs(value - truth[name]) <= limit})
    return out


def report(plan: dict[str, Any]) -> str:
    return json.dumps(plan, indent=1)

