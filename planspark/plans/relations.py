"""Filters, projections, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planspark.functions import scalars as X
from planspark.operators import geometry as G
from planspark.operators import joins as J
from planspark.operators import points as P
from planspark.operators import runs as R
from planspark.plans.bases import base, cte
from planspark.plans.registry import register

PTS, FRM, REG, COR, BOX = (cte(n) for n in ("points", "frames", "regions", "corners", "boxes"))


@register("f1_valid_pixels", PTS + " SELECT frame_id, pos, x, z FROM points WHERE conf >= 2 AND depth > 1e-1 AND depth < 3e0")
def f1(spark, d):
    return base(spark, d, "points").where(P.valid_pixel(F.col("conf"), F.col("depth"), 2, 3.0)).select("frame_id", "pos", "x", "z")


@register("f2_percentile_filter", PTS + " SELECT frame_id, pos, depth FROM points WHERE depth > 2e-1 AND depth < 8e0 AND depth >= (SELECT quantile_cont(depth, 4e-1) FROM points WHERE depth > 2e-1 AND depth < 8e0)")
def f2(spark, d):
    return P.percentile_filter(base(spark, d, "points").where("depth > 2e-1 and depth < 8e0"), "depth", 0.4).select("frame_id", "pos", "depth")


@register("f3_height_band", PTS + " SELECT capture_id, count(*) AS n, count(*) FILTER (WHERE y > 3e-1 AND y < 18e-1) AS rays, count(*) FILTER (WHERE y > 3e-1 AND y < 2e0) AS walls FROM points GROUP BY 1")
def f3(spark, d):
    return base(spark, d, "points").groupBy("capture_id").agg(F.count("*").alias("n"), F.count_if((F.col("y") > 0.3) & (F.col("y") < 1.8)).alias("rays"), F.count_if((F.col("y") > 0.3) & (F.col("y") < 2.0)).alias("walls"))


@register("f5_in_grid", PTS + """, c AS (SELECT CAST(floor((x + 3e0) / 1e-1) AS BIGINT) AS col, CAST(floor((z + 3e0) / 1e-1) AS BIGINT) AS "row" FROM points) SELECT col, "row" FROM c WHERE col >= 0 AND col < 60 AND "row" >= 0 AND "row" < 60""")
def f5(spark, d):
    rows = base(spark, d, "points").select(X.cell(F.col("x"), 0.1, -3.0).alias("col"), X.cell(F.col("z"), 0.1, -3.0).alias("row"))
    return rows.where((F.col("col") >= 0) & (F.col("col") < 60) & (F.col("row") >= 0) & (F.col("row") < 60))


@register("f6_frame_stride", FRM + """ SELECT capture_id, frame_id, CAST(i AS INTEGER) AS "index" FROM (SELECT capture_id, frame_id, row_number() OVER (PARTITION BY capture_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY capture_id) AS n FROM frames) WHERE i % 5 = 0 AND i < n - 1""")
def f6(spark, d):
    return P.strided(base(spark, d, "frames").select("capture_id", "frame_id"), 5, ["frame_id"], ["capture_id"])


@register("f7_frame_cap", PTS + """ SELECT frame_id, pos, u, v FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY md5(concat('7|', CAST(pos AS VARCHAR), '|', CAST(u AS VARCHAR), '|', CAST(v AS VARCHAR))), pos, u, v) AS i FROM points) WHERE i <= 4""")
def f7(spark, d):
    """At most four points of a frame, picked by a seeded hash; a sampling operator."""
    return P.capped(base(spark, d, "points").select("frame_id", "pos", "u", "v"), 4, ["frame_id"], ["pos", "u", "v"], seed=7)


@register("f9_plausible_height", FRM + " SELECT capture_id, frame_id, CASE WHEN x >= 1e0 AND x <= 195e-2 THEN x END AS height, NOT (x >= 1e0 AND x <= 195e-2) AS suppressed FROM frames")
def f9(spark, d):
    ok = F.col("x").between(1.0, 1.95)
    return base(spark, d, "frames").select("capture_id", "frame_id", F.when(ok, F.col("x")).alias("height"), (~ok).alias("suppressed"))


@register("f12_point_in_polygon", COR + """, e AS (SELECT *, coalesce(lead(u) OVER w, first_value(u) OVER w) AS u2, coalesce(lead(v) OVER w, first_value(v) OVER w) AS v2 FROM corners WINDOW w AS (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), p AS (SELECT ring, i AS k, (u + 25e-1) / 2e0 AS pu, (v + 2e0) / 2e0 AS pv FROM corners)
SELECT p.ring, p.k FROM p JOIN e ON p.ring = e.ring GROUP BY p.ring, p.k HAVING count(*) FILTER (WHERE (e.v > pv) <> (e.v2 > pv) AND pu < (e.u2 - e.u) * ((pv - e.v) / nullif(e.v2 - e.v, 0)) + e.u) % 2 = 1""")
def f12(spark, d):
    corners = base(spark, d, "corners")
    points = corners.selectExpr("ring", "i as k", "(u + 25e-1) / 2e0 as pu", "(v + 2e0) / 2e0 as pv")
    return G.inside_polygon(points, G.edges(corners, ["ring"]), ["ring"], ["k"])


@register("f13_detector_rejects", BOX + """ SELECT image, box_id, class, x0 FROM boxes LEFT JOIN (SELECT 'A' AS class, 6e-2 AS least UNION ALL SELECT 'R', 9e-2) m USING (class) WHERE score >= coalesce(least, 0e0) AND (x1 - x0) * (y1 - y0) <= 6e-1 * 50000e0""")
def f13(spark, d):
    least = spark.createDataFrame([("A", 0.06), ("R", 0.09)], "class string, least double")
    rows = base(spark, d, "boxes").join(F.broadcast(least), "class", "left")
    return rows.where((F.col("score") >= F.coalesce("least", F.lit(0.0))) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= 0.6 * 50000.0)).select("image", "box_id", "class", "x0")


@register("f14_visible_files", """ SELECT page_id, lower(regexp_extract(url, '\\.([a-z]+)$', 1)) AS extension FROM pages WHERE NOT regexp_matches(url, '/(__MACOSX|\\.)') AND lower(regexp_extract(url, '\\.([a-z]+)$', 1)) IN ('html', 'jpg')""")
def f14(spark, d):
    extension = F.lower(F.regexp_extract("url", r"\.([a-z]+)$", 1))
    return spark.read.parquet(f"{d}/pages.parquet").where(~F.col("url").rlike(r"/(__MACOSX|\.)") & extension.isin("html", "jpg")).select("page_id", extension.alias("extension"))


@register("f16_match_count", PTS + " SELECT capture_id, frame_id, count(*) AS n FROM points GROUP BY 1, 2 HAVING count(*) >= 4")
def f16(spark, d):
    return base(spark, d, "points").groupBy("capture_id", "frame_id").agg(F.count("*").alias("n")).where("n >= 4")


@register("p1_rotation", FRM + """, n AS (SELECT frame_id, qx / q AS x, qy / q AS y, qz / q AS z, qw / q AS w FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS q FROM frames)) SELECT frame_id, round(1 - 2 * (y * y + z * z), 6) + 0e0 AS r00, round(2 * (x * y - z * w), 6) + 0e0 AS r01, round(2 * (x * z + y * w), 6) + 0e0 AS r02, round(2 * (x * y + z * w), 6) + 0e0 AS r10, round(1 - 2 * (x * x + y * y), 6) + 0e0 AS r22 FROM n""")
def p1(spark, d):
    r = X.rotation(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    return base(spark, d, "frames").select("frame_id", *[(F.round(r[i], 6) + 0.0).alias(n) for i, n in ((0, "r00"), (1, "r01"), (2, "r02"), (3, "r10"), (8, "r22"))])


@register("p3_back_project", cte("points", "frames") + """, n AS (SELECT frame_id, x AS tx, z AS tz, qx / q AS x, qy / q AS y, qz / q AS z, qw / q AS w FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS q FROM frames)), c AS (SELECT frame_id, pos, (u + 5e-1 - 128e0) * depth / 210e0 AS cx, (v + 5e-1 - 96e0) * depth / 210e0 AS cy, depth AS cz FROM points WHERE conf >= 1 AND depth > 1e-1 AND depth < 5e0)
SELECT frame_id, pos, round((1 - 2 * (y * y + z * z)) * cx + 2 * (x * y - z * w) * cy + 2 * (x * z + y * w) * cz + tx, 5) AS wx, round(2 * (x * y + z * w) * cx + (1 - 2 * (x * x + z * z)) * cy + 2 * (y * z - x * w) * cz + 15e-1, 5) AS wy, round(2 * (x * z - y * w) * cx + 2 * (y * z + x * w) * cy + (1 - 2 * (x * x + y * y)) * cz + tz, 5) AS wz FROM c JOIN n USING (frame_id)""")
def p3(spark, d):
    pixels = base(spark, d, "points").where(P.valid_pixel(F.col("conf"), F.col("depth"), 1, 5.0)).select("frame_id", "pos", "u", "v", "depth")
    poses = base(spark, d, "frames").select("frame_id", F.col("x").alias("tx"), F.col("z").alias("tz"), "qx", "qy", "qz", "qw")
    camera = X.camera_point(F.col("u"), F.col("v"), F.col("depth"), 210.0, 210.0, 128.0, 96.0)
    world = X.transform(X.rotation(*[F.col(c) for c in ("qx", "qy", "qz", "qw")]), [F.col("tx"), F.lit(1.5), F.col("tz")], camera)
    return pixels.join(poses, "frame_id").select("frame_id", "pos", *[F.round(c, 5).alias(n) for c, n in zip(world, ("wx", "wy", "wz"), strict=True)])


@register("p5_plan_rotation", PTS + " SELECT frame_id, pos, round(cos(5e-1) * x - sin(5e-1) * z, 6) AS u, round(sin(5e-1) * x + cos(5e-1) * z, 6) AS v FROM points")
def p5(spark, d):
    u, v = X.plan_rotate(F.col("x"), F.col("z"), 0.5)
    return base(spark, d, "points").select("frame_id", "pos", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@register("p8_walls", COR + """, e AS (SELECT *, coalesce(lead(u) OVER w, first_value(u) OVER w) AS u2, coalesce(lead(v) OVER w, first_value(v) OVER w) AS v2 FROM corners WINDOW w AS (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), l AS (SELECT *, sqrt((u2 - u) ** 2 + (v2 - v) ** 2) AS length FROM e)
SELECT ring, i, round(length, 4) AS value, round(length - 1645e-3 * sqrt(2e-4 + 2e-4 + 2e-4 + (2e-2 * length) ** 2), 4) AS lo, round(length + 1645e-3 * sqrt(2e-4 + 2e-4 + 2e-4 + (2e-2 * length) ** 2), 4) AS hi FROM l""")
def p8(spark, d):
    length = F.hypot(F.col("u2") - F.col("u"), F.col("v2") - F.col("v"))
    sigma = F.sqrt(F.lit(2e-4) + 2e-4 + 2e-4 + (0.02 * length) * (0.02 * length))
    m = X.measurement(length, sigma, "m")
    return G.edges(base(spark, d, "corners"), ["ring"]).select("ring", "i", m["value"].alias("value"), m["lo"].alias("lo"), m["hi"].alias("hi"))


@register("p9_area", COR + """, e AS (SELECT *, coalesce(lead(u) OVER w, first_value(u) OVER w) AS u2, coalesce(lead(v) OVER w, first_value(v) OVER w) AS v2 FROM corners WINDOW w AS (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT ring, round(sum(u * v2 - v * u2) / 2, 5) + 0e0 AS area, round(sum(sqrt((u2 - u) ** 2 + (v2 - v) ** 2)), 5) AS perimeter FROM e GROUP BY 1""")
def p9(spark, d):
    out = G.signed_area(G.edges(base(spark, d, "corners"), ["ring"]), ["ring"])
    return out.select("ring", (F.round("area", 5) + 0.0).alias("area"), F.round("perimeter", 5).alias("perimeter"))


@register("a20_box_sides", COR + " SELECT ring, round(least(max(u) - min(u), max(v) - min(v)), 6) AS short, round(greatest(max(u) - min(u), max(v) - min(v)), 6) AS long FROM corners GROUP BY 1")
def a20(spark, d):
    out = G.box_sides(base(spark, d, "corners"), ["ring"])
    return out.select("ring", F.round("short", 6).alias("short"), F.round("long", 6).alias("long"))


@register("p12_yaw_snap", FRM + " SELECT frame_id, round(round_even(x / (pi() / 2), 0) * (pi() / 2), 6) AS yaw FROM frames")
def p12(spark, d):
    return base(spark, d, "frames").select("frame_id", F.round(X.snap_yaw(F.col("x")), 6).alias("yaw"))


@register("p13_circular_mean", FRM + " SELECT capture_id, round(atan2(avg(sin(x)), avg(cos(x))), 6) AS mean FROM frames GROUP BY 1")
def p13(spark, d):
    return base(spark, d, "frames").groupBy("capture_id").agg(F.round(F.atan2(F.avg(F.sin("x")), F.avg(F.cos("x"))), 6).alias("mean"))


@register("p18_field_of_view", FRM + " SELECT frame_id, round(degrees(2 * atan(1920e0 / (2 * (800e0 + price / 1000e0)))), 6) AS fov, CASE WHEN degrees(2 * atan(1920e0 / (2 * (800e0 + price / 1000e0)))) > 90 THEN 'wide' ELSE 'main' END AS lens FROM frames")
def p18(spark, d):
    fov = X.field_of_view(F.lit(1920.0), 800.0 + F.col("price") / 1000.0)
    return base(spark, d, "frames").select("frame_id", F.round(fov, 6).alias("fov"), F.when(fov > 90, "wide").otherwise("main").alias("lens"))


@register("p20_one_spaced", r" SELECT page_id, trim(regexp_replace(url, '[/\-_]+', ' ', 'g')) AS words FROM pages")
def p20(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.one_spaced(F.regexp_replace("url", r"[/\-_]+", " ")).alias("words"))


@register("p23_mean_reading", REG + " SELECT room_id, d_ord, round((coalesce(bottom, 0e0) + length) / (CASE WHEN bottom IS NULL THEN 1 ELSE 2 END), 6) AS mean FROM regions")
def p23(spark, d):
    return base(spark, d, "regions").select("room_id", "d_ord", F.round(X.mean_reading(F.array("bottom", "length")), 6).alias("mean"))


@register("p24_band_error", REG + " SELECT d_ord, round(CASE WHEN length < 4e-1 THEN length - 4e-1 WHEN length > 9e-1 THEN length - 9e-1 ELSE 0e0 END, 6) AS error FROM regions")
def p24(spark, d):
    return base(spark, d, "regions").select("d_ord", F.round(X.band_error(F.col("length"), F.lit(0.4), F.lit(0.9)), 6).alias("error"))


@register("j1_region_rooms", REG + """, r AS (SELECT DISTINCT room_id, floor_area FROM regions WHERE room_id % 3 <> 0), w AS (SELECT DISTINCT surface_id, wall_length FROM regions WHERE wall_length IS NOT NULL AND surface_id <> 'w3') SELECT g.d_ord, g.room_id, r.floor_area, w.wall_length AS wall FROM regions g JOIN r ON r.room_id = g.room_id AND r.floor_area = g.floor_area LEFT JOIN w ON w.surface_id = g.surface_id AND w.wall_length = g.wall_length""")
def j1(spark, d):
    g = base(spark, d, "regions")
    rooms = g.where("room_id % 3 <> 0").select("room_id", "floor_area").distinct()
    walls = g.where("wall_length is not null and surface_id <> 'w3'").select("surface_id", "wall_length", F.col("wall_length").alias("wall")).distinct()
    return g.join(rooms, ["room_id", "floor_area"]).join(walls, ["surface_id", "wall_length"], "left").select("d_ord", "room_id", "floor_area", "wall")


_WALLS = [(0, 1.0, -6.0, 1.0, 6.0), (1, -6.0, 2.0, 6.0, 2.0), (2, -3.0, -6.0, -3.0, 0.0)]


@register("j4_segment_crossings", PTS + """, w AS (SELECT * FROM (VALUES (0, 1e0, -6e0, 1e0, 6e0), (1, -6e0, 2e0, 6e0, 2e0), (2, -3e0, -6e0, -3e0, 0e0)) t(wall, cx, cy, dx, dy)), s AS (SELECT capture_id, wall, ((cx - 0e0) * (dy - cy) - (cy - 0e0) * (dx - cx)) / nullif((x - 0e0) * (dy - cy) - (z - 0e0) * (dx - cx), 0) AS s, ((cx - 0e0) * (z - 0e0) - (cy - 0e0) * (x - 0e0)) / nullif((x - 0e0) * (dy - cy) - (z - 0e0) * (dx - cx), 0) AS t FROM points, w)
SELECT capture_id, CAST(wall AS INTEGER) AS wall, count(*) AS n FROM s WHERE s > 0 AND s < 1 AND t >= 0 AND t <= 1 GROUP BY 1, 2""")
def j4(spark, d):
    walls = spark.createDataFrame(_WALLS, "wall int, cx double, cy double, dx double, dy double")
    c = {n: F.col(n) for n in ("x", "z", "cx", "cy", "dx", "dy")}
    s, t = G.crossing(F.lit(0.0), F.lit(0.0), c["x"], c["z"], c["cx"], c["cy"], c["dx"], c["dy"])
    met = base(spark, d, "points").join(F.broadcast(walls), (s > 0) & (s < 1) & (t >= 0) & (t <= 1))
    return met.groupBy("capture_id", "wall").agg(F.count("*").alias("n"))


@register("j6_in_ranges", FRM + " SELECT capture_id, frame_id FROM frames WHERE frame_id BETWEEN 50 AND 180 OR frame_id BETWEEN 400 AND 420 OR frame_id BETWEEN 410 AND 900")
def j6(spark, d):
    ranges = spark.createDataFrame([(50, 180), (400, 420), (410, 900)], "start long, stop long")
    return J.in_ranges(base(spark, d, "frames").select("capture_id", "frame_id"), ranges, "frame_id", 64)


@register("j7_band_pairs", FRM + " SELECT a.capture_id, a.frame_id AS i, b.frame_id AS j FROM frames a JOIN frames b ON a.capture_id = b.capture_id AND b.frame_id - a.frame_id BETWEEN 1 AND 20")
def j7(spark, d):
    return J.band_pairs(base(spark, d, "frames"), "frame_id", 20, ["capture_id"])


@register("j9_mutual_nearest", """ WITH e AS (SELECT vec_id, vec_id // 20 AS photo, embedding FROM embeddings), p AS (SELECT a.photo, a.vec_id AS a, b.vec_id AS b, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS d FROM e a JOIN e b ON b.photo = a.photo + 1),
x AS (SELECT *, row_number() OVER (PARTITION BY photo, a ORDER BY d, b) AS i, row_number() OVER (PARTITION BY photo, b ORDER BY d, a) AS j FROM p) SELECT photo, a, b FROM x WHERE i = 1 AND j = 1""")
def j9(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / 20).alias("photo"), F.col("embedding").cast("array<double>").alias("e"))
    left, right = e.select("photo", F.col("vec_id").alias("a"), F.col("e").alias("ea")), e.select((F.col("photo") - 1).alias("photo"), F.col("vec_id").alias("b"), F.col("e").alias("eb"))
    distance = F.sqrt(F.aggregate(F.zip_with("ea", "eb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = left.join(right, "photo").select("photo", "a", "b", F.round(distance, 9).alias("d"))
    return J.mutual_nearest(pairs, ["photo"]).select("photo", "a", "b")


@register("j10_nearest_in_time", FRM + """, l AS (SELECT capture_id, frame_id AS t FROM frames WHERE frame_id % 2 = 0), r AS (SELECT capture_id, frame_id AS t FROM frames WHERE frame_id % 2 = 1), k AS (SELECT l.capture_id, l.t AS id, r.t AS m, abs(l.t - r.t) AS gap, row_number() OVER (PARTITION BY l.capture_id, l.t ORDER BY abs(l.t - r.t), r.t) AS i FROM l JOIN r USING (capture_id)) SELECT capture_id, id, m AS "match", gap FROM k WHERE i = 1""")
def j10(spark, d):
    rows = base(spark, d, "frames").where("capture_id is not null").select("capture_id", F.col("frame_id").alias("id"), F.col("frame_id").alias("t"))
    return J.nearest_in_time(rows.where("id % 2 = 0").distinct(), rows.where("id % 2 = 1"), ["capture_id"]).where("match is not null")


@register("j11_shared_frames", PTS + """ SELECT a.capture_id, count(*) AS shared FROM (SELECT DISTINCT capture_id, frame_id FROM points WHERE conf = 0) a JOIN (SELECT DISTINCT capture_id, frame_id FROM points WHERE conf = 1) b USING (capture_id, frame_id) JOIN (SELECT DISTINCT capture_id, frame_id FROM points WHERE conf = 2) c USING (capture_id, frame_id) GROUP BY 1 HAVING count(*) >= 2""")
def j11(spark, d):
    own = lambda k: base(spark, d, "points").where(F.col("conf") == k).select("capture_id", "frame_id").distinct()
    return own(0).join(own(1), ["capture_id", "frame_id"]).join(own(2), ["capture_id", "frame_id"]).groupBy("capture_id").agg(F.count("*").alias("shared")).where("shared >= 2")


@register("j13_revisits", FRM + """, f AS (SELECT frame_id AS id, capture_id, x, z FROM frames) SELECT a.capture_id, a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM f a JOIN f b ON a.capture_id = b.capture_id AND a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 201e-3 AND b.id - a.id >= 3""")
def j13(spark, d):
    rows = base(spark, d, "frames").withColumnRenamed("frame_id", "id")
    return J.near_pairs(rows, 0.201, "id", ["capture_id"]).where("b - a >= 3").withColumn("distance", F.round("distance", 6))


@register("j14_nearest_wall", PTS + """, w AS (SELECT * FROM (VALUES (0, 1e0, -6e0, 1e0, 6e0), (1, -6e0, 2e0, 6e0, 2e0), (2, -3e0, -6e0, -3e0, 0e0)) t(wall, cx, cy, dx, dy)), q AS (SELECT frame_id, pos, x, z, wall, cx, cy, dx, dy, greatest(0e0, least(1e0, ((x - cx) * (dx - cx) + (z - cy) * (dy - cy)) / ((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy)))) AS t FROM points, w),
m AS (SELECT frame_id, pos, x, z, wall, round(sqrt((x - (cx + t * (dx - cx))) ** 2 + (z - (cy + t * (dy - cy))) ** 2), 6) AS distance FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pos, x, z ORDER BY distance, wall) AS i FROM m) SELECT DISTINCT frame_id, pos, CAST(wall AS INTEGER) AS wall, distance FROM k WHERE i = 1 AND distance <= 5e-1""")
def j14(spark, d):
    distance = F.round(G.point_segment(*[F.col(n) for n in ("x", "z", "cx", "cy", "dx", "dy")]), 6)
    every = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(w, ("wall", "cx", "cy", "dx", "dy"), strict=True)]) for w in _WALLS]))
    met = base(spark, d, "points").withColumn("w", every).select("*", "w.*").withColumn("distance", distance).where("distance <= 5e-1")
    return J.closest(met, ["frame_id", "pos", "x", "z"], "wall", ["distance", "wall"]).select("frame_id", "pos", "wall", "distance").distinct()


@register("j19_unplaced", FRM + " SELECT DISTINCT capture_id, frame_id FROM frames WHERE frame_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def j19(spark, d):
    placed = base(spark, d, "points").where("pos = 3").select("frame_id")
    return base(spark, d, "frames").select("capture_id", "frame_id").distinct().join(placed, "frame_id", "left_anti").select("capture_id", "frame_id")


@register("j20_visited", FRM + " SELECT capture_id, count(*) AS n FROM frames f WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = f.frame_id AND l.l_linenumber = 3) GROUP BY 1")
def j20(spark, d):
    visited = base(spark, d, "points").where("pos = 3").select("frame_id")
    return base(spark, d, "frames").join(visited, "frame_id", "left_semi").groupBy("capture_id").agg(F.count("*").alias("n"))


@register("j21_truth_fallback", REG + """, t AS (SELECT * FROM (VALUES ('w1', 1), ('w2', 2), ('*', 9)) t(key, truth)), k AS (SELECT g.d_ord, t.truth, row_number() OVER (PARTITION BY g.d_ord ORDER BY CASE WHEN t.key = g.surface_id THEN 0 ELSE 1 END) AS i FROM regions g JOIN t ON t.key = g.surface_id OR t.key = '*') SELECT d_ord, CAST(truth AS INTEGER) AS truth FROM k WHERE i = 1""")
def j21(spark, d):
    truth = spark.createDataFrame([("w1", 1), ("w2", 2), ("*", 9)], "key string, truth int")
    exact, other = truth.where("key <> '*'"), truth.where("key = '*'").select("truth").scalar()
    rows = base(spark, d, "regions").join(F.broadcast(exact), F.col("surface_id") == F.col("key"), "left")
    return rows.select("d_ord", F.coalesce("truth", other).alias("truth"))


@register("r1_closed_cells", PTS + """, c AS (SELECT DISTINCT capture_id, CAST(floor(x / 25e-2) AS BIGINT) AS col, CAST(floor(z / 25e-2) AS BIGINT) AS "row" FROM points WHERE y > 1e0), o AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)), d AS (SELECT DISTINCT capture_id, col + a AS col, "row" + b AS "row" FROM c, o)
SELECT capture_id, col + a AS col, "row" + b AS "row" FROM d, o GROUP BY 1, 2, 3 HAVING count(*) = 9""")
def r1(spark, d):
    cells = P.raster(base(spark, d, "points").where("y > 1e0"), 0.25, ["capture_id"])
    return G.close(cells, G.square(1), ["capture_id"])


@register("r22_pruned_pieces", FRM + """, p AS (SELECT capture_id, frame_id AS piece, frame_id AS first, frame_id + 5 + frame_id * 7 % 60 AS last FROM frames), k AS (SELECT *, max(last) OVER (PARTITION BY capture_id ORDER BY first, last DESC, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p) SELECT capture_id, piece, first, last FROM k WHERE reach IS NULL OR last > reach""")
def r22(spark, d):
    rows = base(spark, d, "frames").selectExpr("capture_id", "frame_id as piece", "frame_id as first", "frame_id + 5 + frame_id * 7 % 60 as last")
    return R.prune_contained(rows, ["capture_id"])


@register("t1_sorted_links", PTS + " SELECT capture_id, frame_id, n, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, frame_id) AS INTEGER) AS rank FROM (SELECT capture_id, frame_id, count(*) AS n FROM points GROUP BY 1, 2)")
def t1(spark, d):
    rows = base(spark, d, "points").groupBy("capture_id", "frame_id").agg(F.count("*").alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("n"), "frame_id")))


@register("t5_top_links", PTS + " SELECT capture_id, frame_id, n FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, frame_id) AS i FROM (SELECT capture_id, frame_id, count(*) AS n FROM points GROUP BY 1, 2)) WHERE i <= 15")
def t5(spark, d):
    rows = base(spark, d, "points").groupBy("capture_id", "frame_id").agg(F.count("*").alias("n"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("n"), "frame_id"))).where("i <= 15").drop("i")


@register("u2_shared_labels", PTS + " SELECT capture_id, pos FROM points WHERE conf = 0 INTERSECT SELECT capture_id, pos FROM points WHERE conf = 2")
def u2(spark, d):
    rows = base(spark, d, "points")
    return rows.where("conf = 0").select("capture_id", "pos").intersect(rows.where("conf = 2").select("capture_id", "pos"))


@register("u4_missing_labels", PTS + " SELECT frame_id FROM points WHERE conf = 0 EXCEPT SELECT frame_id FROM points WHERE conf = 2")
def u4(spark, d):
    rows = base(spark, d, "points")
    return rows.where("conf = 0").select("frame_id").exceptAll(rows.where("conf = 2").select("frame_id")).distinct().join(rows.where("conf = 2").select("frame_id"), "frame_id", "left_anti")
