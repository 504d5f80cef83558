"""Audits, gates, states, and the reports of experiments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planspark.functions import scalars as X
from planspark.operators import audits as A
from planspark.operators import points as P
from planspark.operators import scoring as S
from planspark.plans.aggregates import rounded
from planspark.plans.bases import base, cte
from planspark.plans.registry import register

PTS, FRM, REG, MEA, JOB, SLT, BOX = (cte(n) for n in ("points", "frames", "regions", "measures", "jobs", "slots", "boxes"))

_PHOTOS = """ WITH p AS (SELECT concat('room', CAST(p_partkey % 300 AS VARCHAR)) AS room, p_name AS name, 1000 + p_size % 3 * 500 AS w, 1400 AS h, 1 + p_partkey % 8 AS orientation, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 13e0 + p_size % 5 * 9 END AS f35, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 2e0 END AS f_mm FROM part),
k AS (SELECT *, CASE WHEN f35 IS NULL THEN 'unknown' WHEN f35 < 18 THEN '0.5x ultra-wide' WHEN f35 < 35 THEN '1x wide' ELSE concat(CAST(CAST(round_even(f35 / 26, 0) AS INTEGER) AS VARCHAR), 'x tele') END AS lens FROM p),
f AS (SELECT room, name, 'error' AS level, 'no focal length' AS text FROM k WHERE f35 IS NULL AND f_mm IS NULL UNION ALL SELECT room, name, 'warning', concat('lens ', lens) FROM k WHERE lens <> '0.5x ultra-wide' UNION ALL SELECT room, name, 'warning', 'portrait' FROM k WHERE (w > h) = (orientation IN (5, 6, 7, 8))
UNION ALL SELECT room, NULL, CASE WHEN n < 2 OR n > 8 THEN 'error' ELSE 'warning' END, concat(CAST(n AS VARCHAR), ' photos') FROM (SELECT room, count(*) AS n FROM p GROUP BY 1) WHERE n <> 8)"""


def _findings(spark, d):
    photos = spark.read.parquet(f"{d}/part.parquet").selectExpr("concat('room', p_partkey % 300) as room", "p_name as name", "1000 + p_size % 3 * 500 as w", "1400 as h", "1 + p_partkey % 8 as orientation", "case when p_partkey % 6 = 0 then null else 13e0 + p_size % 5 * 9 end as f35", "case when p_partkey % 4 = 0 then null else 2e0 end as f_mm")
    return A.photo_findings(photos).unionByName(A.room_findings(photos))


@register("e11_photo_audit", _PHOTOS + " SELECT * FROM f")
def e11_photos(spark, d):
    return _findings(spark, d)


@register("h18_audit_codes", _PHOTOS + " SELECT room, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings, CAST(CASE WHEN count(*) FILTER (WHERE level = 'error') > 0 THEN 1 ELSE 0 END AS INTEGER) AS code FROM f GROUP BY 1")
def h18(spark, d):
    return A.exit_codes(_findings(spark, d), "room")


@register("e10_empty_hints", FRM + """, c AS (SELECT capture_id, CASE capture_id % 4 WHEN 0 THEN 'photos' WHEN 1 THEN 'video' WHEN 2 THEN 'lidar' ELSE 'other' END AS tier, count(*) FILTER (WHERE status = 'P' AND x > 7.5) AS rooms FROM frames GROUP BY 1)
SELECT capture_id, rooms, CASE WHEN rooms = 0 THEN concat('no room could be measured; ', CASE tier WHEN 'photos' THEN 'take eight overlapping 0.5x photos in a ring in each room' WHEN 'video' THEN 'walk each room slowly, half a minute or more' WHEN 'lidar' THEN 'scan the full perimeter of each room' ELSE '' END) END AS hint FROM c""")
def e10(spark, d):
    tier = F.get(F.array(*[F.lit(t) for t in ("photos", "video", "lidar", "other")]), F.col("capture_id") % 4)
    rows = base(spark, d, "frames").groupBy("capture_id").agg(F.count_if((F.col("status") == "P") & (F.col("x") > 7.5)).alias("rooms"))
    return rows.select("capture_id", "rooms", A.empty_hint(tier, F.col("rooms")).alias("hint"))


@register("e6_opening_kinds", SLT + """, o AS (SELECT wall, slot, count(*) AS support, min(value / 100e0) - 2e-1 AS sill, bool_or(value > 10) AS seen FROM slots GROUP BY 1, 2) SELECT wall, slot, CASE WHEN seen AND sill > 5e-1 THEN 'window' WHEN 5e-1 + slot % 10 / 1e1 <= 12e-1 THEN 'door' ELSE 'open_passage' END AS kind, CASE WHEN seen THEN round(least(1e0, support * 30 / 200e0), 2) ELSE 3e-1 END AS confidence, CASE WHEN seen THEN round(greatest(sill, 0e0), 6) ELSE 0e0 END AS sill FROM o""")
def e6(spark, d):
    runs = base(spark, d, "slots").groupBy("wall", "slot").agg((F.count("*") * 30).alias("support"), (F.min(F.col("value") / 100.0) - 0.2).alias("sill"), F.bool_or(F.col("value") > 10).alias("seen")).withColumn("width", 0.5 + F.col("slot") % 10 / 10.0)
    return rounded(A.opening_kinds(runs).select("wall", "slot", "kind", "confidence", "sill"), "sill")


@register("e4_finalized", REG + " SELECT room_id, concat('D', CAST(row_number() OVER (ORDER BY room_id, d_ord) AS VARCHAR)) AS id, surface_id, class, d_ord, round(area, 4) AS area FROM regions")
def e4(spark, d):
    """Damage regions numbered over the whole plan, with the fields of its schema; ranks come from counts of rooms before."""
    rows = base(spark, d, "regions")
    before = rows.groupBy("room_id").agg(F.count("*").alias("n")).select("room_id", F.coalesce(F.sum("n").over(Window.orderBy("room_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("room_id").orderBy("d_ord"))
    return rows.join(before, "room_id").select("room_id", F.concat(F.lit("D"), number).alias("id"), "surface_id", "class", "d_ord", F.round("area", 4).alias("area"))


_SET = """ WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'drift.method' WHEN 1 THEN 'recon.image_long_side' ELSE 'other' END AS key, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'off' ELSE c_mktsegment END WHEN 1 THEN CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END ELSE '1' END AS value FROM customer)"""


@register("f15_wrong_settings", _SET + " SELECT c_custkey, key, value FROM s WHERE (key = 'drift.method' AND value NOT IN ('off', 'posegraph')) OR (key = 'recon.image_long_side' AND coalesce(try_cast(value AS INTEGER) % 14 <> 0, true))")
def f15(spark, d):
    k = F.col("c_custkey")
    key = F.when(k % 3 == 0, "drift.method").when(k % 3 == 1, "recon.image_long_side").otherwise("other")
    value = F.when(k % 3 == 0, F.when(k % 2 == 0, "off").otherwise(F.col("c_mktsegment"))).when(k % 3 == 1, F.when(k % 5 == 0, "x").otherwise(k.cast("string"))).otherwise("1")
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", key.alias("key"), value.alias("value"))
    return A.wrong_settings(rows, {"drift.method": ("off", "posegraph")}, {"recon.image_long_side": 14})


_FILES = """ WITH f AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS asset, page_id, lpad(CAST(page_id AS VARCHAR), 12, '0') AS name, CAST(length(html) AS BIGINT) AS bytes, sha256(html) AS sha256, page_id % 211 = 0 AS gps FROM pages)"""


def _files(spark, d):
    name = F.lpad(F.col("page_id").cast("string"), 12, "0")
    return spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("asset"), "page_id", name.alias("name"), F.length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"), (F.col("page_id") % 211 == 0).alias("gps"))


@register("f18_refused_assets", _FILES + " SELECT asset, count(*) AS flagged FROM f WHERE gps GROUP BY 1")
def f18(spark, d):
    return A.refused(_files(spark, d), F.col("gps"))


@register("a32_release_manifest", _FILES + " SELECT asset, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(sha256, '' ORDER BY name)) AS sha256 FROM f WHERE asset NOT IN (SELECT asset FROM f WHERE gps) GROUP BY 1")
def a32(spark, d):
    return A.released(_files(spark, d), F.col("gps"))


_STATE = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


def _states(spark, d):
    return base(spark, d, "jobs").selectExpr("job_id", "event_id", "ts", f"{_STATE.replace('event_type', 'status')} as status", "value")


_STEPS = JOB + f", s AS (SELECT job_id, event_id, ts, {_STATE.replace('event_type', 'status')} AS status, value FROM jobs)"


@register("st3_interrupted_jobs", _STEPS + ", l AS (SELECT job_id, arg_max(status, struct_pack(t := ts, e := event_id)) AS status, count(*) AS steps FROM s GROUP BY 1) SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status, steps FROM l")
def st3(spark, d):
    return A.interrupted(_states(spark, d))


@register("k6_job_steps", _STEPS + """, b AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM s) SELECT job_id, event_id, before, status FROM b WHERE NOT coalesce((before = 'queued' AND status IN ('running', 'failed')) OR (before = 'running' AND status IN ('done', 'failed')), status = 'queued')""")
def k6(spark, d):
    """Steps that a job index must not take."""
    return A.bad_steps(_states(spark, d)).select("job_id", "event_id", "before", "status")


@register("st6_health_counts", _STEPS + """ SELECT time_bucket(INTERVAL '1 hour', ts) AS start, CASE WHEN value < 20 THEN 'fail' WHEN value < 40 THEN 'warn' ELSE 'pass' END AS verdict, count(*) AS n FROM s GROUP BY 1, 2""")
def st6(spark, d):
    from planspark.streaming import state

    verdict = F.when(F.col("value") < 20, "fail").when(F.col("value") < 40, "warn").otherwise("pass")
    rows = _states(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), verdict.alias("verdict"))
    return state.tumbling_counts(rows, "1 hour", "verdict").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("p25_last_error_line", """ WITH l AS (SELECT user_id AS job, event_id AS no, CASE WHEN value < 30 THEN concat('ValueError: ', event_type) ELSE concat('step ', event_type) END AS line FROM events) SELECT job, coalesce(arg_max(line, no) FILTER (WHERE line LIKE '%Error%'), arg_max(line, no)) AS error FROM l GROUP BY 1""")
def p25_line(spark, d):
    text = F.when(F.col("value") < 30, F.concat(F.lit("\x1b[31mValueError: "), "event_type", F.lit("\x1b[0m"))).otherwise(F.concat(F.lit("step "), "event_type"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("job"), F.col("event_id").alias("no"), X.without_escapes(text).alias("line"))
    return A.last_errors(rows, "job")


@register("c5_device", """ SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN ['cpu', 'mps', 'cuda'][c_custkey % 4] WHEN c_custkey % 3 = 0 THEN 'cuda' WHEN c_nationkey % 2 = 0 THEN 'mps' ELSE 'cpu' END AS device FROM customer""")
def c5(spark, d):
    from planspark.plans.config import device

    asked = F.get(F.array(*[F.lit(w) for w in ("auto", "cpu", "mps", "cuda")]), F.col("c_custkey") % 4)
    vram = F.when(F.col("c_custkey") % 3 == 0, 16).otherwise(0)
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", device(asked, vram, F.col("c_nationkey") % 2 == 0).alias("device"))


@register("c8_tape_marks", MEA + """, t AS (SELECT space, run, quantity, truth, predicted, abs(predicted - truth) / truth AS share, truth BETWEEN lo AND hi AS holds FROM measures) SELECT quantity, CASE WHEN share <= 3e-2 THEN 'good' WHEN share <= 8e-2 THEN 'fair' ELSE 'poor' END AS mark, holds, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def c8(spark, d):
    rows = A.tape_marks(base(spark, d, "measures").withColumnRenamed("predicted", "value"))
    return rows.groupBy("quantity", "mark", "holds").agg(F.count("*").alias("n"))


@register("a21_opening_gate", MEA + """, p AS (SELECT space, tier, list(round(predicted, 4)) AS pred FROM measures WHERE quantity = 'wall' AND run % 2 = 0 GROUP BY 1, 2), t AS (SELECT space, tier, list(round(truth, 4)) AS truth FROM measures WHERE quantity = 'wall' AND run % 2 = 1 GROUP BY 1, 2),
g AS (SELECT t.space, t.tier, len(list_filter(truth, lambda x: len(list_filter(coalesce(pred, []), lambda y: abs(y - x) <= 2e-2)) > 0)) AS hits, greatest(len(truth), len(coalesce(pred, []))) AS n FROM t LEFT JOIN p USING (space, tier)) SELECT space, tier, hits, n, hits >= 85e-2 * n AS passed FROM g""")
def a21_openings(spark, d):
    """Openings within 2 cm of a truth, over the larger number of both: missed and phantom ones count against."""
    rows = base(spark, d, "measures").where("quantity = 'wall'").withColumn("truth", F.round("truth", 4)).withColumn("predicted", F.round("predicted", 4))
    return S.opening_gate(rows.where("run % 2 = 0").select("space", "tier", "predicted"), rows.where("run % 2 = 1").select("space", "tier", "truth"), ["space", "tier"])


@register("h4_original_pixels", PTS + """, s AS (SELECT frame_id, pos, u, v, 512e0 / 4032e0 AS s, round_even(4032 * (512e0 / 4032e0), 0) AS rw, round_even(3024 * (512e0 / 4032e0), 0) AS rh FROM points) SELECT frame_id, pos, round((u + (rw - 512) / 2) / s, 4) AS x, round((v + (rh - 384) / 2) / s, 4) AS y FROM s""")
def h4(spark, d):
    x, y = X.original_pixel(F.col("u"), F.col("v"), 4032, 3024, 512, 384, 512)
    return base(spark, d, "points").select("frame_id", "pos", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@register("h5_height_report", PTS + """, h AS (SELECT capture_id, CAST(floor(y / 5e-2) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bin DESC) AS i FROM h), s AS (SELECT capture_id, round(avg(CASE WHEN y > 19e-1 THEN 1e0 ELSE 0e0 END), 6) AS high FROM points GROUP BY 1) SELECT k.capture_id, CAST(i AS INTEGER) AS rank, bin, n, high FROM k JOIN s USING (capture_id) WHERE i <= 6""")
def h5(spark, d):
    rows = base(spark, d, "points")
    top = P.histogram(rows, "y", 0.05, ["capture_id"]).withColumn("rank", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("n"), F.desc("bin")))).where("rank <= 6")
    high = rows.groupBy("capture_id").agg(F.round(F.avg(F.when(F.col("y") > 1.9, 1.0).otherwise(0.0)), 6).alias("high"))
    return top.join(high, "capture_id").select("capture_id", "rank", "bin", "n", "high")


_LINKS = """, l AS (SELECT least(x, y) AS a, greatest(x, y) AS b, n FROM (SELECT l_suppkey % 12 AS x, l_partkey % 12 AS y, CAST(l_quantity AS BIGINT) AS n FROM lineitem))"""


def _links(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    x, y = F.col("l_suppkey") % 12, F.col("l_partkey") % 12
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col("l_quantity").cast("long").alias("n"))


@register("h7_match_statistics", PTS + _LINKS + " SELECT a = b AS same_room, count(*) AS pairs, round(median(n), 4) AS median, max(n) AS most, count(*) FILTER (WHERE n >= 15) AS verified FROM l GROUP BY 1")
def h7(spark, d):
    return _links(spark, d).groupBy((F.col("a") == F.col("b")).alias("same_room")).agg(F.count("*").alias("pairs"), F.round(F.median("n"), 4).alias("median"), F.max("n").alias("most"), F.count_if(F.col("n") >= 15).alias("verified"))


_BOTH = FRM + """, f AS (SELECT capture_id AS a, frame_id % 16 AS b, avg(x) AS yaw, avg(z) AS t FROM frames GROUP BY 1, 2)"""


@register("h8_both_directions", _BOTH + " SELECT f.a, f.b, round(f.yaw, 6) AS yaw_ab, round(r.yaw, 6) AS yaw_ba, round(f.yaw + r.yaw, 6) AS gap FROM f JOIN f r ON r.a = f.b AND r.b = f.a WHERE f.a < f.b")
def h8(spark, d):
    links = base(spark, d, "frames").groupBy(F.col("capture_id").alias("a"), (F.col("frame_id") % 16).alias("b")).agg(F.avg("x").alias("yaw"))
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("yaw").alias("yaw_ba"))
    both = links.where("a < b").join(back, ["a", "b"])
    return both.select("a", "b", F.round("yaw", 6).alias("yaw_ab"), F.round("yaw_ba", 6).alias("yaw_ba"), F.round(F.col("yaw") + F.col("yaw_ba"), 6).alias("gap"))


@register("h9_camera_spread", FRM + " SELECT capture_id, round(greatest(max(x) - min(x), max(z) - min(z)), 6) AS spread, count(*) AS views FROM frames GROUP BY 1")
def h9(spark, d):
    span = lambda c: F.max(c) - F.min(c)
    return base(spark, d, "frames").groupBy("capture_id").agg(F.round(F.greatest(span("x"), span("z")), 6).alias("spread"), F.count("*").alias("views"))


@register("h10_external_links", PTS + _LINKS + """, s AS (SELECT n_nationkey % 12 AS room, 5e-1 + n_nationkey / 1e2 AS scale FROM nation WHERE n_nationkey < 12), e AS (SELECT l.a, l.b, 'given' AS origin, round(l.n * s.scale, 4) AS n FROM l JOIN s ON s.room = l.a UNION ALL SELECT a, b, 'own', n * 1e0 FROM l) SELECT a, b, origin, count(*) AS links, round(sum(n), 3) AS total FROM e GROUP BY 1, 2, 3""")
def h10(spark, d):
    """Given links rescaled to each photo, joined with our own."""
    scale = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 12").selectExpr("cast(n_nationkey as bigint) as a", "5e-1 + n_nationkey / 1e2 as scale")
    links = _links(spark, d)
    given = links.join(scale, "a").select("a", "b", F.lit("given").alias("origin"), F.round(F.col("n") * F.col("scale"), 4).alias("n"))
    both = given.unionByName(links.select("a", "b", F.lit("own").alias("origin"), F.col("n").cast("double").alias("n")))
    return both.groupBy("a", "b", "origin").agg(F.count("*").alias("links"), F.round(F.sum("n"), 3).alias("total"))


@register("h11_keyframes_by_piece", FRM + " SELECT capture_id, frame_id % 6 AS piece, count(*) AS keyframes, round(avg(x), 6) AS x, round(avg(z), 6) AS z FROM frames GROUP BY 1, 2")
def h11(spark, d):
    return base(spark, d, "frames").groupBy("capture_id", (F.col("frame_id") % 6).alias("piece")).agg(F.count("*").alias("keyframes"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("z"), 6).alias("z"))


@register("h12_registration", FRM + " SELECT capture_id, count(*) FILTER (WHERE status <> 'P') AS registered, count(DISTINCT frame_id % 6) AS models, round(count(*) FILTER (WHERE status <> 'P') / CAST(count(*) AS DOUBLE), 4) AS share, concat(CAST(count(*) FILTER (WHERE status <> 'P') AS VARCHAR), '/', CAST(count(*) AS VARCHAR)) AS label FROM frames GROUP BY 1")
def h12(spark, d):
    ok, n = F.count_if(F.col("status") != "P"), F.count("*")
    return base(spark, d, "frames").groupBy("capture_id").agg(ok.alias("registered"), F.countDistinct(F.col("frame_id") % 6).alias("models"), F.round(ok / n, 4).alias("share"), F.concat(ok.cast("string"), F.lit("/"), n.cast("string")).alias("label"))


@register("h13_piece_bridges", FRM + """, p AS (SELECT capture_id, CAST(floor(frame_id / 100) AS BIGINT) AS piece, min(frame_id) AS first, max(frame_id) AS last, count(*) AS n FROM frames GROUP BY 1, 2), b AS (SELECT *, lead(first) OVER (PARTITION BY capture_id ORDER BY first) AS next FROM p) SELECT capture_id, piece, next - last AS gap, next - last <= 20 AND n >= 3 AS joined FROM b WHERE next IS NOT NULL""")
def h13(spark, d):
    pieces = base(spark, d, "frames").groupBy("capture_id", F.floor(F.col("frame_id") / 100).alias("piece")).agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count("*").alias("n"))
    gap = F.lead("first").over(Window.partitionBy("capture_id").orderBy("first")) - F.col("last")
    return pieces.withColumn("gap", gap).where("gap is not null").select("capture_id", "piece", "gap", ((F.col("gap") <= 20) & (F.col("n") >= 3)).alias("joined"))


@register("h14_ablation", MEA + """ SELECT space, round(avg(CASE WHEN tier = 'lidar' THEN predicted END), 6) AS a, round(avg(CASE WHEN tier = 'video' THEN predicted END), 6) AS b, round(avg(CASE WHEN tier = 'photos' THEN predicted END), 6) AS c, round(any_value(m.truth), 6) AS truth FROM measures JOIN (SELECT space, avg(truth) AS truth FROM measures GROUP BY 1) m USING (space) GROUP BY 1""")
def h14(spark, d):
    """One value by three inputs side by side, with the truth."""
    rows = base(spark, d, "measures")
    wide = rows.groupBy("space").pivot("tier", ["lidar", "video", "photos"]).agg(F.round(F.avg("predicted"), 6))
    return wide.withColumnsRenamed({"lidar": "a", "video": "b", "photos": "c"}).join(rows.groupBy("space").agg(F.round(F.avg("truth"), 6).alias("truth")), "space")


@register("h15_drift_matrix", FRM + """, m AS (SELECT unnest(['off', 'posegraph']) AS method), s AS (SELECT capture_id, sum(abs(x - z)) AS total, count(*) AS n FROM frames GROUP BY 1) SELECT capture_id, method, round(total / n * CASE method WHEN 'off' THEN 1e0 ELSE 5e-1 END, 6) AS misfit, n FROM s, m""")
def h15(spark, d):
    """Every capture under both settings; the settings are an array, so no join is needed."""
    rows = base(spark, d, "frames").groupBy("capture_id").agg(F.sum(F.abs(F.col("x") - F.col("z"))).alias("total"), F.count("*").alias("n")).withColumn("method", F.explode(F.array(F.lit("off"), F.lit("posegraph"))))
    return rows.select("capture_id", "method", F.round(F.col("total") / F.col("n") * F.when(F.col("method") == "off", 1.0).otherwise(0.5), 6).alias("misfit"), "n")


@register("h2_set_rows", MEA + """, s AS (SELECT space, run, median(truth / predicted) AS scale, count(*) AS n FROM measures GROUP BY 1, 2) SELECT m.space, m.run, any_value(s.n) AS n, CASE WHEN any_value(s.n) >= 20 THEN round(avg(abs(predicted * scale - truth) / truth), 6) END AS absrel, CASE WHEN any_value(s.n) < 20 THEN 'too few pixels' END AS error FROM measures m JOIN s ON s.space = m.space AND s.run = m.run GROUP BY 1, 2""")
def h2(spark, d):
    """A row a set; sets that cannot be scored have an error in place of a figure."""
    rows = base(spark, d, "measures").withColumnRenamed("predicted", "depth")
    scored = S.depth_errors(rows, ["space", "run"]).join(rows.groupBy("space", "run").agg(F.count("*").alias("n")), ["space", "run"])
    enough = F.col("n") >= 20
    return scored.select("space", "run", "n", F.when(enough, F.round("absrel", 6)).alias("absrel"), F.when(~enough, "too few pixels").alias("error"))


@register("h19_views_in_rooms", FRM + """, r AS (SELECT unnest([0, 1, 2, 3]) AS room), i AS (SELECT capture_id, room, frame_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY capture_id, room) AS n FROM frames, r WHERE x >= room * 2e0 AND x < room * 2e0 + 2e0 AND z < 4e0 WINDOW w AS (PARTITION BY capture_id, room ORDER BY frame_id)) SELECT capture_id, CAST(room AS INTEGER) AS room, frame_id FROM i WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda k: CAST(round_even(k * (n - 1) / 7e0, 0) AS BIGINT)), i)""")
def h19(spark, d):
    """Up to eight views of each room, evenly spread over those taken inside it."""
    from planspark.operators.runs import even_picks

    inside = base(spark, d, "frames").where("x >= 0 and x < 8e0 and z < 4e0").select("capture_id", F.floor(F.col("x") / 2).cast("int").alias("room"), "frame_id")
    return even_picks(inside, 8, ["capture_id", "room"], ["frame_id"]).drop("index")


@register("s9_sampled_frames", FRM + """, t AS (SELECT capture_id, frame_id, frame_id / 3e1 AS ts FROM frames) SELECT capture_id, CAST(floor(ts * 8e0) AS BIGINT) AS sample, min(frame_id) AS frame_id FROM t GROUP BY 1, 2""")
def s9(spark, d):
    """Frames of a film at eight a second."""
    rows = base(spark, d, "frames").select("capture_id", "frame_id", (F.col("frame_id") / 30.0).alias("ts"))
    return P.sampled(rows, 8.0, ["capture_id"]).select("capture_id", "sample", "frame_id")


@register("s10_selected_frames", cte("frames", "points") + """ SELECT capture_id, frame_id, status FROM frames WHERE frame_id IN (SELECT frame_id FROM points WHERE conf = 2 AND depth > 5e0)""")
def s10(spark, d):
    """Frames that damage was looked for in, read in one pass."""
    wanted = base(spark, d, "points").where("conf = 2 and depth > 5e0").select("frame_id")
    return base(spark, d, "frames").join(wanted, "frame_id", "left_semi").select("capture_id", "frame_id", "status")


@register("h17_rolled_poses", FRM + """, n AS (SELECT frame_id, qx / q AS x, qy / q AS y, qz / q AS z, qw / q AS w FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS q FROM frames)), r AS (SELECT frame_id, frame_id % 3 - 1 AS turns, 1 - 2 * (y * y + z * z) AS r0, 2 * (x * y - z * w) AS r1, 2 * (x * z + y * w) AS r2 FROM n)
SELECT frame_id, round(CASE turns WHEN 1 THEN r1 WHEN -1 THEN -r1 ELSE r0 END, 6) + 0e0 AS m0, round(CASE turns WHEN 1 THEN -r0 WHEN -1 THEN r0 ELSE r1 END, 6) + 0e0 AS m1, round(r2, 6) + 0e0 AS m2 FROM r""")
def h17(spark, d):
    """First row of each frame's rotation after its image was turned upright."""
    r = X.rolled(X.rotation(*[F.col(c) for c in ("qx", "qy", "qz", "qw")]), F.col("frame_id") % 3 - 1)
    return base(spark, d, "frames").select("frame_id", *[(F.round(r[i], 6) + 0.0).alias(f"m{i}") for i in range(3)])


@register("h23_job_summary", _STEPS + """ SELECT job_id, count(*) AS steps, CAST(CASE WHEN arg_max(status, struct_pack(t := ts, e := event_id)) = 'done' THEN 0 ELSE 1 END AS INTEGER) AS code, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS seconds FROM s GROUP BY 1""")
def h23(spark, d):
    """Steps, exit code and whole seconds of each job."""
    rows = _states(spark, d)
    last = F.max_by("status", F.struct("ts", "event_id"))
    seconds = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))
    return rows.groupBy("job_id").agg(F.count("*").alias("steps"), F.when(last == "done", 0).otherwise(1).alias("code"), seconds.alias("seconds"))


@register("h24_missing_weights", """ SELECT p_brand AS asset, count(*) AS parts, count(*) FILTER (WHERE p_size < 5) AS missing FROM part GROUP BY 1 HAVING count(*) FILTER (WHERE p_size < 5) > 0""")
def h24(spark, d):
    """Assets with parts that are not there yet, which a setup would fetch."""
    return spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("asset")).agg(F.count("*").alias("parts"), F.count_if(F.col("p_size") < 5).alias("missing")).where("missing > 0")
