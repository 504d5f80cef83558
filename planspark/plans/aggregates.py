"""Aggregations, windows and levels over points, frames and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planspark.operators import points as P
from planspark.operators import runs as R
from planspark.operators import scoring as S
from planspark.plans.bases import base, cte
from planspark.plans.registry import register

PTS, FRM, MEA, SLT, JOB = (cte(n) for n in ("points", "frames", "measures", "slots", "jobs"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@register("a1_voxel_fuse", PTS + """ SELECT CAST(floor(x / 5e-1) AS BIGINT) AS kx, CAST(floor(y / 5e-1) AS BIGINT) AS ky, CAST(floor(z / 5e-1) AS BIGINT) AS kz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n
FROM points WHERE conf >= 1 AND depth > 1e-1 AND depth < 4e0 GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def a1(spark, d):
    rows = base(spark, d, "points").where(P.valid_pixel(F.col("conf"), F.col("depth"), 1, 4.0))
    return rounded(P.voxel_fuse(rows, 0.5), "x", "y", "z")


@register("a2_voxelize", PTS + """ SELECT capture_id, CAST(floor(x / 1e0) AS BIGINT) AS kx, CAST(floor(y / 1e0) AS BIGINT) AS ky, CAST(floor(z / 1e0) AS BIGINT) AS kz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM points GROUP BY 1, 2, 3, 4""")
def a2(spark, d):
    return rounded(P.voxel_fuse(base(spark, d, "points"), 1.0, 1, ["capture_id"]), "x", "y", "z")


@register("a3_raster_count", PTS + """ SELECT capture_id, CAST(floor(x / 25e-2) AS BIGINT) AS col, CAST(floor(z / 25e-2) AS BIGINT) AS "row", count(*) AS n FROM points GROUP BY 1, 2, 3""")
def a3(spark, d):
    return P.raster(base(spark, d, "points"), 0.25, ["capture_id"])


@register("a4_vertical_coverage", PTS + """ SELECT capture_id, CAST(floor(x / 5e-1) AS BIGINT) AS col, CAST(floor(z / 5e-1) AS BIGINT) AS "row", round(count(DISTINCT floor((y - 2e-1) / 1e-1)) / 16e0, 6) AS coverage FROM points WHERE y > 2e-1 AND y < 18e-1 GROUP BY 1, 2, 3""")
def a4(spark, d):
    return rounded(P.vertical_coverage(base(spark, d, "points"), 0.5, 0.2, 1.8, 0.1, ["capture_id"]), "coverage")


@register("a5_ray_carve", PTS + """, r AS (SELECT capture_id, 3e-3 AS x0, 7e-3 AS z0, x + 1e-3 AS x1, z + 2e-3 AS z1, sqrt((x + 1e-3 - 3e-3) ** 2 + (z + 2e-3 - 7e-3) ** 2) AS length FROM points WHERE y > 3e-1 AND y < 18e-1),
w AS (SELECT *, unnest(range(0, CAST(floor((length - 5e-2) / 5e-1) AS BIGINT) + 1)) AS k FROM r WHERE length > 55e-2)
SELECT capture_id, CAST(floor((x0 + (x1 - x0) * (k * 5e-1 / length)) / 5e-1) AS BIGINT) AS col, CAST(floor((z0 + (z1 - z0) * (k * 5e-1 / length)) / 5e-1) AS BIGINT) AS "row", count(*) AS n FROM w GROUP BY 1, 2, 3""")
def a5(spark, d):
    rays = base(spark, d, "points").where("y > 3e-1 and y < 18e-1").selectExpr("capture_id", "3e-3 as x0", "7e-3 as z0", "x + 1e-3 as x1", "z + 2e-3 as z1")
    return P.carve(rays, 0.5, 0.05, ["capture_id"])


@register("a6_histogram", PTS + " SELECT capture_id, CAST(floor(y / 1e-1) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2")
def a6(spark, d):
    return P.histogram(base(spark, d, "points"), "y", 0.1, ["capture_id"])


@register("a7_fullest_bin", PTS + """, h AS (SELECT capture_id, CAST(floor(y / 1e-1) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bin) AS i FROM h) SELECT capture_id, bin, n FROM k WHERE i = 1""")
def a7(spark, d):
    return P.fullest_bin(P.histogram(base(spark, d, "points"), "y", 0.1, ["capture_id"]), ["capture_id"])


@register("a9_refined_level", PTS + """, a AS (SELECT capture_id, median(y) AS level FROM points WHERE abs(y - 1e0) < 4e-2 GROUP BY 1)
SELECT p.capture_id, round(median(p.y), 6) AS level, round(stddev_pop(p.y), 6) AS spread, count(*) AS n, round(12533e-4 * stddev_pop(p.y) / sqrt(count(*)), 6) AS sigma FROM points p JOIN a USING (capture_id) WHERE abs(p.y - a.level) < 2e-2 GROUP BY 1""")
def a9(spark, d):
    rows = base(spark, d, "points")
    guess = rows.select("capture_id", F.lit(1.0).alias("guess")).distinct()
    return rounded(P.refined_level(rows, guess, ["capture_id"]), "level", "spread", "sigma")


@register("a13_percentiles", PTS + """ SELECT capture_id, round(quantile_cont(y, 2e-2), 6) AS p02, round(quantile_cont(y, 3e-1), 6) AS p30, round(median(y), 6) AS p50, round(quantile_cont(y, 98e-2), 6) AS p98 FROM points GROUP BY 1""")
def a13(spark, d):
    found = P.quantiles(base(spark, d, "points"), "y", {"p02": 0.02, "p30": 0.3, "p50": 0.5, "p98": 0.98}, ["capture_id"])
    return rounded(found, "p02", "p30", "p50", "p98")


@register("a14_scale_ratio", MEA + """, m AS (SELECT space, run, median(predicted / truth) AS m FROM measures GROUP BY 1, 2)
SELECT space, round(median(m), 6) AS scale, round(stddev_pop(m), 6) AS spread, count(*) AS n, round(125e-2 * stddev_pop(m) / sqrt(count(*)), 6) AS se FROM m GROUP BY 1""")
def a14(spark, d):
    rows = base(spark, d, "measures").withColumn("ratio", F.col("predicted") / F.col("truth"))
    return rounded(S.median_of_medians(rows, ["space"], "run", "ratio"), "scale", "spread", "se")


@register("a18_slot_counts", SLT + """, n AS (SELECT wall, slot, count(*) AS n, count(*) FILTER (WHERE value > 50) AS through, min(value) AS low FROM slots GROUP BY 1, 2), w AS (SELECT wall, unnest(range(0, 90)) AS slot FROM (SELECT DISTINCT wall FROM slots))
SELECT w.wall, CAST(w.slot AS BIGINT) AS slot, coalesce(n.n, 0) AS n, coalesce(n.through, 0) AS through, n.low FROM w LEFT JOIN n ON n.wall = w.wall AND n.slot = w.slot""")
def a18(spark, d):
    rows = base(spark, d, "slots")
    counts = rows.groupBy("wall", "slot").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("through"), F.min("value").alias("low"))
    every = rows.select("wall").distinct().select("wall", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(89).cast("long"))).alias("slot"))
    return every.join(counts, ["wall", "slot"], "left").select("wall", "slot", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("through", F.lit(0)).alias("through"), "low")


@register("a19_path_summary", FRM + """, s AS (SELECT *, x - lag(x) OVER w AS dx, z - lag(z) OVER w AS dz FROM frames WINDOW w AS (PARTITION BY capture_id ORDER BY frame_id))
SELECT capture_id, round(sum(sqrt(dx * dx + dz * dz)), 4) AS path, max(frame_id) - min(frame_id) AS span, round(sqrt((arg_max(x, frame_id) - arg_min(x, frame_id)) ** 2 + (arg_max(z, frame_id) - arg_min(z, frame_id)) ** 2), 6) AS gap FROM s GROUP BY 1""")
def a19(spark, d):
    w = Window.partitionBy("capture_id").orderBy("frame_id")
    step = base(spark, d, "frames").withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("z") - F.lag("z").over(w)))
    ends = lambda c: F.max_by(c, "frame_id") - F.min_by(c, "frame_id")
    return step.groupBy("capture_id").agg(F.round(F.sum("step"), 4).alias("path"), (F.max("frame_id") - F.min("frame_id")).alias("span"), F.round(F.hypot(ends("x"), ends("z")), 6).alias("gap"))


@register("a21_gates", MEA + """, t AS (SELECT *, predicted - truth AS error, CASE WHEN quantity = 'wall' THEN CASE tier WHEN 'photos' THEN 8e-2 * truth WHEN 'video' THEN 3e-2 * truth ELSE greatest(2e-2, 1e-2 * truth) END WHEN quantity = 'area' THEN CASE tier WHEN 'photos' THEN 1e-1 WHEN 'video' THEN 5e-2 ELSE 2e-2 END * truth ELSE 15e-3 END AS tolerance FROM measures)
SELECT quantity, tier, count(*) AS n, count(*) FILTER (WHERE abs(error) <= tolerance - 1e-9) AS passed, round(avg(abs(error)), 6) AS error FROM t GROUP BY 1, 2""")
def a21(spark, d):
    rows = S.gates(base(spark, d, "measures"))
    return rows.groupBy("quantity", "tier").agg(F.count("*").alias("n"), F.count_if(F.abs("error") <= F.col("tolerance") - 1e-9).alias("passed"), F.round(F.avg(F.abs("error")), 6).alias("error"))


@register("a22_calibration", MEA + """ SELECT quantity, tier, count(*) FILTER (WHERE truth >= lo AND truth <= hi) AS held, count(*) AS n, round(count(*) FILTER (WHERE truth >= lo AND truth <= hi) / CAST(count(*) AS DOUBLE), 6) AS share FROM measures GROUP BY GROUPING SETS ((quantity, tier), (quantity), (tier), ())""")
def a22(spark, d):
    return S.coverage(base(spark, d, "measures"))


@register("a23_repeatability", MEA + """ SELECT space, quantity, count(CASE WHEN run <> 3 THEN predicted END) AS runs, round(avg(CASE WHEN run <> 3 THEN predicted END), 6) AS mean, round(max(CASE WHEN run <> 3 THEN predicted END) - min(CASE WHEN run <> 3 THEN predicted END), 6) AS "range", round(stddev_samp(CASE WHEN run <> 3 THEN predicted END), 6) AS std FROM measures GROUP BY 1, 2""")
def a23(spark, d):
    rows = base(spark, d, "measures").withColumn("predicted", F.when(F.col("run") != 3, F.col("predicted")))
    return rounded(S.repeatability(rows, ["space", "quantity"], "predicted"), "mean", "range", "std")


@register("a24_depth_errors", MEA + """, s AS (SELECT space, median(truth / predicted) AS scale FROM measures GROUP BY 1) SELECT space, round(any_value(scale), 6) AS scale, round(avg(abs(predicted * scale - truth) / truth), 6) AS absrel FROM measures JOIN s USING (space) GROUP BY 1""")
def a24(spark, d):
    rows = base(spark, d, "measures").withColumnRenamed("predicted", "depth")
    return rounded(S.depth_errors(rows, ["space"]), "scale", "absrel")


@register("a25_wall_sharpness", PTS + """, h AS (SELECT capture_id, CAST(floor(x / 1e-1) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bin) AS i, count(*) OVER (PARTITION BY capture_id) AS bins FROM h)
SELECT capture_id, round(sum(CASE WHEN i * 20 <= bins THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share FROM k GROUP BY 1""")
def a25(spark, d):
    w = Window.partitionBy("capture_id")
    bins = P.histogram(base(spark, d, "points"), "x", 0.1, ["capture_id"]).withColumn("i", F.row_number().over(w.orderBy(F.desc("n"), "bin"))).withColumn("bins", F.count("*").over(w))
    return bins.groupBy("capture_id").agg(F.round(F.sum(F.when(F.col("i") * 20 <= F.col("bins"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"))


@register("a27_footprint", cte("regions") + """ SELECT room_id, round(sum(area), 4) AS total, round(sqrt(sum(25e-4 * area * area)), 6) AS sigma, count(*) AS n FROM regions GROUP BY 1""")
def a27(spark, d):
    return base(spark, d, "regions").groupBy("room_id").agg(F.round(F.sum("area"), 4).alias("total"), F.round(F.sqrt(F.sum(0.0025 * F.col("area") * F.col("area"))), 6).alias("sigma"), F.count("*").alias("n"))


@register("a28_best_pair", PTS + """, p AS (SELECT least(capture_id, frame_id % 8 * 3 % 8) AS a, greatest(capture_id, frame_id % 8 * 3 % 8) AS b, frame_id, depth FROM points), k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY depth DESC, frame_id) AS i FROM p WHERE a <> b) SELECT a, b, round(depth, 6) AS depth, frame_id FROM k WHERE i = 1""")
def a28(spark, d):
    rows = base(spark, d, "points").selectExpr("least(capture_id, frame_id % 8 * 3 % 8) as a", "greatest(capture_id, frame_id % 8 * 3 % 8) as b", "frame_id", "depth").where("a <> b")
    return rows.groupBy("a", "b").agg(F.round(F.max("depth"), 6).alias("depth"), F.max_by("frame_id", F.struct("depth", -F.col("frame_id"))).alias("frame_id"))


@register("a29_evidence_union", cte("regions") + """ SELECT room_id, class, array_to_string(list_sort(list_distinct(list(surface_id))), ',') AS evidence FROM regions GROUP BY 1, 2""")
def a29(spark, d):
    return base(spark, d, "regions").groupBy("room_id", "class").agg(F.array_join(F.array_sort(F.collect_set("surface_id")), ",").alias("evidence"))


@register("a30_majority", FRM + """, c AS (SELECT capture_id, status, count(*) AS n FROM frames GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, status DESC) AS i FROM c) SELECT capture_id, status, n FROM k WHERE i = 1""")
def a30(spark, d):
    counts = base(spark, d, "frames").groupBy("capture_id", "status").agg(F.count("*").alias("n"))
    return counts.groupBy("capture_id").agg(F.max_by("status", F.struct("n", "status")).alias("status"), F.max("n").alias("n"))


@register("a31_digest", cte("regions") + """ SELECT room_id, substr(sha256(array_to_string(list_sort(list(concat(class, '=', surface_id, '#', CAST(d_ord AS VARCHAR)))), '|')), 1, 24) AS digest FROM regions GROUP BY 1""")
def a31(spark, d):
    part = F.concat("class", F.lit("="), "surface_id", F.lit("#"), F.col("d_ord").cast("string"))
    return base(spark, d, "regions").groupBy("room_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "|"), 256), 1, 24).alias("digest"))


@register("w1_box_sum", PTS + """, h AS (SELECT capture_id, CAST(floor(y / 1e-1) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2), d AS (SELECT capture_id, unnest(range(min(bin), max(bin) + 1)) AS bin FROM h GROUP BY capture_id), f AS (SELECT d.capture_id, d.bin, coalesce(n, 0) AS n FROM d LEFT JOIN h ON d.capture_id = h.capture_id AND d.bin = h.bin)
SELECT capture_id, bin, n, CAST(sum(n) OVER (PARTITION BY capture_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s FROM f""")
def w1(spark, d):
    return P.box_sum(P.dense(P.histogram(base(spark, d, "points"), "y", 0.1, ["capture_id"]), ["capture_id"]), 2, ["capture_id"])


@register("w2_floor_level", PTS + """, h AS (SELECT capture_id, CAST(floor(y / 1e-2) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2), d AS (SELECT capture_id, unnest(range(min(bin), max(bin) + 1)) AS bin FROM h GROUP BY capture_id), f AS (SELECT d.capture_id, d.bin, coalesce(n, 0) AS n FROM d LEFT JOIN h ON d.capture_id = h.capture_id AND d.bin = h.bin),
s AS (SELECT *, sum(n) OVER (PARTITION BY capture_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM f), p AS (SELECT *, max(s) OVER (PARTITION BY capture_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS peak FROM s),
b AS (SELECT *, max(s) OVER (PARTITION BY capture_id) AS most FROM p WHERE (bin + 5e-1) * 1e-2 < 15e-1 - 6e-1), g AS (SELECT capture_id, min(CASE WHEN s >= 4e-1 * most AND s >= peak THEN bin END) AS bin, max(n) AS top FROM b GROUP BY 1)
SELECT g.capture_id, coalesce(g.bin, min(b.bin)) AS bin FROM g JOIN b ON b.capture_id = g.capture_id AND b.n = g.top GROUP BY g.capture_id, g.bin""")
def w2(spark, d):
    return P.floor_level(base(spark, d, "points"), 1.5, ["capture_id"])


@register("w3_open_runs", SLT + """, o AS (SELECT wall, slot, bool_or(value > 25) AS open, min(CASE WHEN value > 25 THEN value / 100e0 END) AS sill FROM slots GROUP BY 1, 2), h AS (SELECT *, coalesce(lag(open) OVER w, false) AND coalesce(lead(open) OVER w, false) AS beside FROM o WINDOW w AS (PARTITION BY wall ORDER BY slot)),
k AS (SELECT *, slot - row_number() OVER (PARTITION BY wall ORDER BY slot) AS run FROM h WHERE open OR beside), r AS (SELECT wall, run, min(slot) AS first, count(*) AS slots, min(sill) AS sill FROM k GROUP BY 1, 2)
SELECT wall, round(first * 1e-1, 6) AS "offset", round(slots * 1e-1, 6) AS width, round(coalesce(sill, 0e0), 6) AS sill, CASE WHEN coalesce(sill, 0e0) > 5e-1 THEN 'window' WHEN slots * 1e-1 <= 12e-1 THEN 'door' ELSE 'open_passage' END AS kind FROM r WHERE slots * 1e-1 >= 25e-2 AND slots * 1e-1 <= 305e-2""")
def w3(spark, d):
    slots = base(spark, d, "slots").groupBy("wall", "slot").agg(F.bool_or(F.col("value") > 25).alias("open"), F.min(F.when(F.col("value") > 25, F.col("value") / 100.0)).alias("sill"))
    return rounded(R.open_runs(slots, ["wall"], 0.1, 0.25, 3.05), "offset", "width", "sill")


@register("w4_even_picks", FRM + """, n AS (SELECT capture_id, frame_id, row_number() OVER (PARTITION BY capture_id ORDER BY frame_id) - 1 AS "index", count(*) OVER (PARTITION BY capture_id) AS size FROM frames)
SELECT capture_id, frame_id, CAST("index" AS INTEGER) AS "index" FROM n WHERE size <= 8 OR list_contains(list_transform(range(0, 8), lambda i: CAST(round_even(i * (size - 1) / 7e0, 0) AS BIGINT)), "index")""")
def w4(spark, d):
    return R.even_picks(base(spark, d, "frames").select("capture_id", "frame_id"), 8, ["capture_id"], ["frame_id"])


@register("w5_deltas", FRM + """ SELECT capture_id, frame_id, frame_id - lag(frame_id) OVER (PARTITION BY capture_id ORDER BY frame_id) AS gap FROM frames""")
def w5(spark, d):
    return base(spark, d, "frames").select("capture_id", "frame_id", (F.col("frame_id") - F.lag("frame_id").over(Window.partitionBy("capture_id").orderBy("frame_id"))).alias("gap"))


@register("w6_latest_job", JOB + """ SELECT job_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS i FROM jobs) WHERE i = 1""")
def w6(spark, d):
    return R.latest(base(spark, d, "jobs"), ["job_id"], [F.desc("ts"), F.desc("event_id")]).select("job_id", "event_id", "status")


@register("w9_index_windows", FRM + """, n AS (SELECT capture_id, count(*) AS n FROM frames GROUP BY 1), s AS (SELECT capture_id, n, unnest(CASE WHEN n <= 16 THEN [0] ELSE list_distinct(list_concat(range(0, n - 16 + 1, 12), [n - 16])) END) AS first FROM n) SELECT capture_id, CAST(first AS BIGINT) AS first, least(first + 16, n) - 1 AS last FROM s""")
def w9(spark, d):
    return R.index_windows(base(spark, d, "frames").groupBy("capture_id").agg(F.count("*").alias("n")), 16, 4, ["capture_id"])


@register("w10_fragments", FRM + """, n AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY capture_id) AS size FROM frames), f AS (SELECT capture_id, least(floor(i / 24e0), greatest(floor(size / 24e0), 1) - 1) AS fragment, i FROM n) SELECT capture_id, CAST(fragment AS BIGINT) AS fragment, min(i) AS first, max(i) AS last, count(*) AS n FROM f GROUP BY 1, 2""")
def w10(spark, d):
    rows = base(spark, d, "frames").withColumn("index", (F.row_number().over(Window.partitionBy("capture_id").orderBy("frame_id")) - 1).cast("long"))
    return P.fragments(rows, 24, ["capture_id"]).groupBy("capture_id", "fragment").agg(F.min("index").alias("first"), F.max("index").alias("last"), F.count("*").alias("n"))


@register("st4_tumbling", """ SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def st4(spark, d):
    from planspark.streaming import state

    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.tumbling_counts(rows, "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("st7_sessions", """ WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def st7(spark, d):
    from planspark.streaming import state

    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.sessions(rows, "30 minutes").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("st5_sliding_peak", """ SELECT start, max(value) AS peak FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start, value FROM events) GROUP BY 1""")
def st5(spark, d):
    from planspark.streaming import state

    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.sliding_peak(rows, "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))
