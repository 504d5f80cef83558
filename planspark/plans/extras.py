"""More joins, scalars, levels and formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planspark.functions import scalars as X
from planspark.operators import points as P
from planspark.operators import runs as R
from planspark.plans.bases import base, cte
from planspark.plans.registry import register

PTS, FRM, REG, MEA, SLT = (cte(n) for n in ("points", "frames", "regions", "measures", "slots"))


@register("f8_every_nth", FRM + """ SELECT capture_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_id) - 1 AS i FROM frames) WHERE i % 7 = 0""")
def f8(spark, d):
    w = Window.partitionBy("capture_id").orderBy("frame_id")
    return base(spark, d, "frames").withColumn("i", F.row_number().over(w) - 1).where("i % 7 = 0").select("capture_id", "frame_id")


@register("f11_link_candidates", FRM + """, l AS (SELECT frame_id, capture_id AS a, frame_id % 16 AS b, x AS yaw, z AS t FROM frames WHERE capture_id < frame_id % 16), r AS (SELECT frame_id % 16 AS a, capture_id AS b, avg(x) AS yaw, avg(z) AS t, count(*) AS n FROM frames WHERE capture_id > frame_id % 16 GROUP BY 1, 2)
SELECT l.frame_id, l.a, l.b FROM l JOIN r ON l.a = r.a AND l.b = r.b WHERE abs(degrees(atan2(sin(l.yaw - r.yaw), cos(l.yaw - r.yaw)))) <= 10.5 AND abs(l.t - r.t) <= greatest(1e0, 5e-1 * abs(l.t))""")
def f11(spark, d):
    """Forward links whose backward ones agree in yaw and offset."""
    rows = base(spark, d, "frames")
    forward = rows.where("capture_id < frame_id % 16").selectExpr("frame_id", "capture_id as a", "frame_id % 16 as b", "x as yaw", "z as t")
    back = rows.where("capture_id > frame_id % 16").groupBy((F.col("frame_id") % 16).alias("a"), F.col("capture_id").alias("b")).agg(F.avg("x").alias("yaw2"), F.avg("z").alias("t2"))
    turn = F.abs(F.degrees(X.wrap_angle(F.col("yaw") - F.col("yaw2")))) <= 10.5
    near = F.abs(F.col("t") - F.col("t2")) <= F.greatest(F.lit(1.0), 0.5 * F.abs("t"))
    return forward.join(back, ["a", "b"]).where(turn & near).select("frame_id", "a", "b")


@register("f17_border", PTS + " SELECT frame_id, pos, u, v FROM points WHERE u >= 3 AND u < 253 AND v >= 3 AND v < 189")
def f17(spark, d):
    return base(spark, d, "points").where("u >= 3 and u < 253 and v >= 3 and v < 189").select("frame_id", "pos", "u", "v")


@register("f19_proxy_frames", FRM + """, m AS (SELECT capture_id, median(price) AS sharp, quantile_cont(x, 4e-1) AS view FROM frames GROUP BY 1) SELECT f.capture_id, f.frame_id FROM frames f JOIN m USING (capture_id) WHERE f.price >= m.sharp AND f.x >= m.view AND f.z > 1e0 AND f.z < 5e0""")
def f19(spark, d):
    rows = base(spark, d, "frames")
    bounds = rows.groupBy("capture_id").agg(F.median("price").alias("sharp"), F.percentile("x", F.lit(0.4)).alias("view"))
    return rows.join(bounds, "capture_id").where("price >= sharp and x >= view and z > 1e0 and z < 5e0").select("capture_id", "frame_id")


@register("p4_similarity", PTS + " SELECT frame_id, pos, round(2e0 * (6e-1 * x - 8e-1 * z) + 1e0, 6) + 0e0 AS x, round(2e0 * (8e-1 * x + 6e-1 * z) - 3e0, 6) + 0e0 AS z FROM points")
def p4(spark, d):
    x, _, z = X.transform([F.lit(v) for v in (0.6, 0.0, -0.8, 0.0, 1.0, 0.0, 0.8, 0.0, 0.6)], [F.lit(0.0)] * 3, [F.col("x"), F.col("y"), F.col("z")])
    return base(spark, d, "points").select("frame_id", "pos", (F.round(2.0 * x + 1.0, 6) + 0.0).alias("x"), (F.round(2.0 * z - 3.0, 6) + 0.0).alias("z"))


@register("p7_pixel_sample", PTS + """, s AS (SELECT frame_id, pos, CAST(floor(u * 5e-1) AS INTEGER) AS su, CAST(floor(v * 5e-1) AS INTEGER) AS sv FROM points), g AS (SELECT frame_id, CAST(floor(u * 5e-1) AS INTEGER) AS su, CAST(floor(v * 5e-1) AS INTEGER) AS sv, min(depth) AS depth FROM points GROUP BY 1, 2, 3) SELECT frame_id, pos, round(depth, 6) AS depth FROM s JOIN g USING (frame_id, su, sv)""")
def p7(spark, d):
    """Depth of the half-resolution pixel under each full-resolution point: an equality join on frame and floored pixel."""
    rows = base(spark, d, "points").withColumn("su", F.floor(F.col("u") * 0.5).cast("int")).withColumn("sv", F.floor(F.col("v") * 0.5).cast("int"))
    grid = rows.groupBy("frame_id", "su", "sv").agg(F.min("depth").alias("d"))
    return rows.join(grid, ["frame_id", "su", "sv"]).select("frame_id", "pos", F.round("d", 6).alias("depth"))


@register("p10_measurement", REG + " SELECT d_ord, round(length, 4) AS value, round(length - 1645e-3 * (1e-2 + length * 31e-3), 4) AS lo, round(length + 1645e-3 * (1e-2 + length * 31e-3), 4) AS hi FROM regions")
def p10(spark, d):
    m = X.measurement(F.col("length"), 0.01 + F.col("length") * 0.031, "m")
    return base(spark, d, "regions").select("d_ord", m["value"].alias("value"), m["lo"].alias("lo"), m["hi"].alias("hi"))


@register("p15_frame_angles", FRM + """, n AS (SELECT frame_id, qx / q AS x, qy / q AS y, qz / q AS z, qw / q AS w FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS q FROM frames)) SELECT frame_id, round(atan2(2 * (x * z + y * w), 1 - 2 * (x * x + y * y)), 6) + 0e0 AS yaw, round(asin(greatest(-1e0, least(1e0, 2 * (y * z - x * w)))), 6) + 0e0 AS pitch FROM n""")
def p15(spark, d):
    r = X.rotation(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r[5])))
    return base(spark, d, "frames").select("frame_id", (F.round(F.atan2(r[2], r[8]), 6) + 0.0).alias("yaw"), (F.round(pitch, 6) + 0.0).alias("pitch"))


@register("p17_box_to_view", cte("boxes") + " SELECT image, box_id, x0, CAST(floor(least(x0, 1000e0) / 1000e0 * 256) AS BIGINT) AS px0, CAST(floor(least(y1, 1000e0) / 1000e0 * 192) AS BIGINT) AS py1 FROM boxes WHERE score >= 5e-2")
def p17(spark, d):
    at = lambda c, n: F.floor(F.least(F.col(c), F.lit(1000.0)) / 1000.0 * n)
    return base(spark, d, "boxes").where("score >= 5e-2").select("image", "box_id", "x0", at("x0", 256).alias("px0"), at("y1", 192).alias("py1"))


@register("p19_formatted", REG + " SELECT d_ord, concat('r', CAST(room_id AS VARCHAR), '.', surface_id, ': ', class) AS label FROM regions")
def p19(spark, d):
    return base(spark, d, "regions").select("d_ord", F.format_string("r%d.%s: %s", "room_id", "surface_id", "class").alias("label"))


@register("p25_last_error", cte("jobs") + """ SELECT job_id, arg_max(status, event_id) AS last_status FROM jobs WHERE status <> 'click' GROUP BY 1""")
def p25(spark, d):
    rows = base(spark, d, "jobs").where(F.col("status") != "click").withColumn("status", X.without_escapes(F.concat(F.lit("\x1b[31m"), F.col("status"), F.lit("\x1b[0m"))))
    return rows.groupBy("job_id").agg(F.max_by("status", "event_id").alias("last_status"))


@register("p26_pose_gaps", FRM + """, k AS (SELECT capture_id, frame_id AS t, CASE WHEN frame_id % 3 = 0 THEN x END AS x FROM frames), b AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, last_value(x IGNORE NULLS) OVER p AS x0, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1, first_value(x IGNORE NULLS) OVER n AS x1 FROM k
WINDOW p AS (PARTITION BY capture_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY capture_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT capture_id, t, round(CASE WHEN t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / CAST(t1 - t0 AS DOUBLE) END, 6) AS x FROM b""")
def p26(spark, d):
    """Positions between known poses, interpolated from the brackets on both sides; null outside."""
    rows = base(spark, d, "frames").select("capture_id", F.col("frame_id").alias("t"), F.when(F.col("frame_id") % 3 == 0, F.col("x")).alias("x"))
    out = R.brackets(rows, ["capture_id"], "t", F.when(F.col("x").isNotNull(), F.struct("t", "x")), "a", "b")
    x = F.when(F.col("b.t") == F.col("a.t"), F.col("a.x")).otherwise(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("t") - F.col("a.t")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0)))
    return out.select("capture_id", "t", F.round(x, 6).alias("x"))


@register("j5_visible_slots", SLT + """, s AS (SELECT DISTINCT wall % 10 AS wall, slot FROM slots), c AS (SELECT * FROM (VALUES (0, 2e0, 1e0, 1e0, 0e0), (1, 6e0, 2e0, 0e0, -1e0)) t(cam, cx, cy, fx, fy)) SELECT wall, slot FROM s WHERE EXISTS (SELECT 1 FROM c WHERE sqrt((slot * 1e-1 - cx) ** 2 + (wall * 1e0 - cy) ** 2) < 6e0 AND (slot * 1e-1 - cx) * fx + (wall * 1e0 - cy) * fy > 72e-2 * sqrt((slot * 1e-1 - cx) ** 2 + (wall * 1e0 - cy) ** 2))""")
def j5(spark, d):
    cameras = spark.createDataFrame([(0, 2.0, 1.0, 1.0, 0.0), (1, 6.0, 2.0, 0.0, -1.0)], "cam int, cx double, cy double, fx double, fy double")
    slots = base(spark, d, "slots").select((F.col("wall") % 10).alias("wall"), "slot").distinct()
    dx, dy = F.col("slot") * 0.1 - F.col("cx"), F.col("wall") * 1.0 - F.col("cy")
    distance = F.sqrt(dx * dx + dy * dy)
    return slots.join(F.broadcast(cameras), (distance < 6.0) & (dx * F.col("fx") + dy * F.col("fy") > 0.72 * distance), "left_semi")


@register("j8_cross_room_pairs", FRM + """, n AS (SELECT CAST(floor(frame_id / 12) AS BIGINT) AS visit, frame_id, frame_id % 3 AS room FROM frames) SELECT a.visit, a.frame_id AS a, b.frame_id AS b FROM n a JOIN n b ON a.visit = b.visit WHERE a.frame_id < b.frame_id AND a.room <> b.room""")
def j8(spark, d):
    """Pairs of photos in different rooms; a visit is a dozen photos in a row."""
    rows = base(spark, d, "frames").select(F.floor(F.col("frame_id") / 12).alias("visit"), "frame_id", (F.col("frame_id") % 3).alias("room"))
    a, b = rows.select("visit", F.col("frame_id").alias("a"), F.col("room").alias("ra")), rows.select("visit", F.col("frame_id").alias("b"), F.col("room").alias("rb"))
    return a.join(b, "visit").where("a < b and ra <> rb").select("visit", "a", "b")


@register("j12_shared_views", FRM + """, n AS (SELECT capture_id, count(*) AS n FROM frames GROUP BY 1), s AS (SELECT capture_id, n, unnest(CASE WHEN n <= 16 THEN [0] ELSE list_distinct(list_concat(range(0, n - 16 + 1, 12), [n - 16])) END) AS first FROM n), w AS (SELECT *, least(first + 16, n) - 1 AS last, lead(first) OVER (PARTITION BY capture_id ORDER BY first) AS next FROM s) SELECT capture_id, first, CAST(last - next + 1 AS BIGINT) AS shared FROM w WHERE next IS NOT NULL""")
def j12(spark, d):
    return R.window_overlaps(base(spark, d, "frames").groupBy("capture_id").agg(F.count("*").alias("n")), 16, 4, ["capture_id"])


@register("j15_door_match", REG + """, o AS (SELECT d_ord, room_id, length * 3e0 AS x, area * 5e0 AS z FROM regions), p AS (SELECT a.room_id AS a, b.room_id AS b, a.d_ord AS da, b.d_ord AS db, round(sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM o a JOIN o b ON a.room_id < b.room_id AND sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 601e-3),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY distance, da, db) AS i FROM p) SELECT a, b, da, db, distance FROM k WHERE i = 1""")
def j15(spark, d):
    """Closest pair of doors of every two rooms; doors are compared within and next to their grid cell only.

    Doors of a room in one place have the same distances, so the first of them stands for all.
    """
    from planspark.operators.joins import near_pairs

    doors = base(spark, d, "regions").selectExpr("d_ord as id", "room_id", "length * 3e0 as x", "area * 5e0 as z").groupBy("room_id", "x", "z").agg(F.min("id").alias("id")).withColumn("k", F.lit(0))
    pairs = near_pairs(doors, 0.601, "id", ["k"])
    rooms = doors.select("id", "room_id")
    named = pairs.join(rooms.withColumnsRenamed({"id": "a", "room_id": "ra"}), "a").join(rooms.withColumnsRenamed({"id": "b", "room_id": "rb"}), "b").where("ra <> rb")
    turned = named.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"), F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("da"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("db"), F.round("distance", 6).alias("distance"))
    best = turned.groupBy(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(F.min(F.struct("distance", "da", "db")).alias("m"))
    return best.select("a", "b", "m.da", "m.db", "m.distance")


@register("j17_room_overlap", PTS + """, c AS (SELECT DISTINCT capture_id, floor(x) AS c, floor(z) AS r FROM points WHERE y > 25e-1), n AS (SELECT capture_id, count(*) AS n FROM c GROUP BY 1), p AS (SELECT a.capture_id AS a, b.capture_id AS b, count(*) AS both FROM c a JOIN c b ON a.c = b.c AND a.r = b.r AND a.capture_id < b.capture_id GROUP BY 1, 2) SELECT a, b, round("both" / CAST(least(x.n, y.n) AS DOUBLE), 6) AS share FROM p JOIN n x ON x.capture_id = a JOIN n y ON y.capture_id = b""".replace("AS both FROM c a", "AS shared FROM c a").replace('"both"', "shared"))
def j17(spark, d):
    """Overlap of every two captures by shared cells, over the smaller one."""
    cells = P.raster(base(spark, d, "points").where("y > 25e-1"), 1.0, ["capture_id"])
    sizes = cells.groupBy("capture_id").agg(F.count("*").alias("n"))
    a, b = cells.select(F.col("capture_id").alias("a"), "col", "row"), cells.select(F.col("capture_id").alias("b"), "col", "row")
    both = a.join(b, ["col", "row"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    named = both.join(sizes.withColumnsRenamed({"capture_id": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"capture_id": "b", "n": "nb"}), "b")
    return named.select("a", "b", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("share"))


@register("j22_openings_found", MEA + " SELECT space, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM measures p WHERE p.space = t.space AND p.run % 2 = 0 AND abs(p.predicted - t.truth) <= 201e-4)) AS found FROM (SELECT DISTINCT space, truth FROM measures WHERE run % 2 = 1) t GROUP BY 1")
def j22(spark, d):
    rows = base(spark, d, "measures")
    truth = rows.where("run % 2 = 1").select("space", "truth").distinct()
    near = rows.where("run % 2 = 0").select("space", "predicted").distinct()
    found = truth.join(near, (truth["space"] == near["space"]) & (F.abs(near["predicted"] - truth["truth"]) <= 0.0201), "left_semi").groupBy("space").agg(F.count("*").alias("found"))
    return truth.groupBy("space").agg(F.count("*").alias("n")).join(found, "space", "left").select("space", "n", F.coalesce("found", F.lit(0)).alias("found"))


@register("a16_moments", FRM + " SELECT capture_id, count(*) AS n, round(sum(x * z) - sum(x) * sum(z) / count(*), 3) AS sxz, round(sum(x * x) - sum(x) * sum(x) / count(*), 3) AS sxx FROM frames GROUP BY 1")
def a16(spark, d):
    n = F.count("*")
    return base(spark, d, "frames").groupBy("capture_id").agg(n.alias("n"), F.round(F.sum(F.col("x") * F.col("z")) - F.sum("x") * F.sum("z") / n, 3).alias("sxz"), F.round(F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / n, 3).alias("sxx"))


@register("w11_keyframes", FRM + """, p AS (SELECT capture_id AS piece, count(*) AS length FROM frames GROUP BY 1) SELECT piece, length, CAST(greatest(3, round_even(40 * length / CAST(sum(length) OVER () AS DOUBLE), 0)) AS INTEGER) AS keyframes FROM p""")
def w11(spark, d):
    pieces = base(spark, d, "frames").groupBy(F.col("capture_id").alias("piece")).agg(F.count("*").alias("length"))
    return R.keyframe_shares(pieces, 40)


@register("u1_all_clouds", PTS + " SELECT frame_id, pos, 'near' AS part FROM points WHERE depth < 1e0 UNION ALL SELECT frame_id, pos, 'far' FROM points WHERE depth > 5e0")
def u1(spark, d):
    rows = base(spark, d, "points")
    return rows.where("depth < 1e0").select("frame_id", "pos", F.lit("near").alias("part")).unionByName(rows.where("depth > 5e0").select("frame_id", "pos", F.lit("far").alias("part")))


@register("u6_distinct_labels", PTS + " SELECT DISTINCT capture_id, conf, pos FROM points")
def u6(spark, d):
    return base(spark, d, "points").select("capture_id", "conf", "pos").distinct()


@register("u7_merged_settings", REG + " SELECT d_ord, CASE WHEN d_ord % 2 = 0 THEN class ELSE surface END AS value, surface_id AS other FROM regions")
def u7(spark, d):
    """Two maps of settings merged key by key; the later one wins."""
    late = F.create_map(F.lit("value"), F.when(F.col("d_ord") % 2 == 0, F.col("class")))
    early = F.create_map(F.lit("value"), F.col("surface"), F.lit("other"), F.col("surface_id"))
    late = F.map_filter(late, lambda _, v: v.isNotNull())
    merged = F.map_zip_with(early, late, lambda _, a, b: F.coalesce(b, a))
    return base(spark, d, "regions").select("d_ord", merged["value"].alias("value"), merged["other"].alias("other"))
