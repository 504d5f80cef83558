"""Similarities, chains, lookups, orders and groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planspark.functions import scalars as X
from planspark.operators import damage, graph, joins
from planspark.operators import geometry as G
from planspark.operators import similarity as S
from planspark.plans.aggregates import rounded
from planspark.plans.bases import base, cte
from planspark.plans.registry import register

PTS, FRM, REG, COR, MEA, BOX = (cte(n) for n in ("points", "frames", "regions", "corners", "measures", "boxes"))


def yaw(name: str, angle) -> list:
    """Nine columns of a turn about the upright axis."""
    c, s, o = F.cos(angle), F.sin(angle), F.lit(0.0)
    return [e.alias(f"{name}{i}") for i, e in enumerate([c, o, s, o, F.lit(1.0), o, -s, o, c])]


_VIEWS = """, v AS (SELECT CAST(floor(frame_id / 12) AS BIGINT) AS visit, frame_id, frame_id * 7 % 60 / 1e1 AS ya, frame_id * 7 % 60 / 1e1 - 3e-1 - frame_id % 3 / 2e1 AS yb, x AS ax, z AS az, x * 5e-1 + z * 1e-1 + 1e0 AS bx, z * 5e-1 - x * 1e-1 AS bz FROM frames),
m AS (SELECT visit, count(*) AS n, atan2(sum(sin(ya - yb)), sum(cos(ya - yb))) AS turn, avg(ax) AS ax, avg(az) AS az, avg(bx) AS bx, avg(bz) AS bz, sum(ax * ax) - sum(ax) ** 2 / count(*) + sum(az * az) - sum(az) ** 2 / count(*) AS sa, sum(bx * bx) - sum(bx) ** 2 / count(*) + sum(bz * bz) - sum(bz) ** 2 / count(*) AS sb FROM v GROUP BY 1)"""


def _views(spark, d):
    rows = base(spark, d, "frames").selectExpr("cast(floor(frame_id / 12) as bigint) as visit", "frame_id", "frame_id * 7 % 60 / 1e1 as ya", "frame_id * 7 % 60 / 1e1 - 3e-1 - frame_id % 3 / 2e1 as yb", "x as ax", "z as az", "x * 5e-1 + z * 1e-1 + 1e0 as bx", "z * 5e-1 - x * 1e-1 as bz")
    return rows.select("visit", "frame_id", "ax", F.lit(1.5).alias("ay"), "az", "bx", F.lit(0.75).alias("by"), "bz", *yaw("a", F.col("ya")), *yaw("b", F.col("yb")))


@register("a16_camera_similarity", FRM + _VIEWS + """ SELECT visit, round(sqrt(sa / greatest(sb, 1e-12)), 5) AS s, round(cos(turn), 5) + 0e0 AS r0, round(sin(turn), 5) + 0e0 AS r2, round(ax - sqrt(sa / greatest(sb, 1e-12)) * (cos(turn) * bx + sin(turn) * bz), 4) + 0e0 AS tx, round(az - sqrt(sa / greatest(sb, 1e-12)) * (cos(turn) * bz - sin(turn) * bx), 4) + 0e0 AS tz FROM m WHERE n >= 3""")
def a16(spark, d):
    rows = _views(spark, d)
    enough = rows.groupBy("visit").count().where("count >= 3")
    found = S.shared_views(rows.join(enough.select("visit"), "visit"), ["visit"])
    return found.select("visit", F.round("s", 5).alias("s"), *[(F.round(c, n) + 0.0).alias(c) for c, n in (("r0", 5), ("r2", 5), ("tx", 4), ("tz", 4))])


@register("a15_shared_similarity", FRM + _VIEWS + """, d AS (SELECT capture_id AS visit, median(x / (z + 1e0)) AS s FROM frames WHERE x > 0 AND z + 1e0 > 0 GROUP BY 1 HAVING count(*) >= 50) SELECT m.visit, round(d.s, 6) AS s, round(cos(turn), 5) + 0e0 AS r0, round(ax - d.s * (cos(turn) * bx + sin(turn) * bz), 4) + 0e0 AS tx, round(15e-1 - d.s * 75e-2, 5) AS ty FROM m JOIN d ON d.visit = m.visit""")
def a15(spark, d):
    """Scale by shared pixels, turn and shift by shared views."""
    pixels = base(spark, d, "frames").selectExpr("capture_id as visit", "x as before", "z + 1e0 as after")
    found = S.shared_views(_views(spark, d), ["visit"], S.depth_scale(pixels, ["visit"], 50))
    return found.select("visit", F.round("s", 6).alias("s"), (F.round("r0", 5) + 0.0).alias("r0"), (F.round("tx", 4) + 0.0).alias("tx"), F.round("ty", 5).alias("ty"))


_CHAIN = ", c AS (SELECT CAST(floor(frame_id / 9) AS BIGINT) AS run, frame_id, 1e0 + frame_id % 5 / 2e1 AS s, frame_id * 3 % 20 / 1e1 AS a, x AS tx, z AS tz FROM frames), "


@register("r17_chained", FRM + _CHAIN + """p AS (SELECT *, coalesce(exp(sum(ln(s)) OVER w), 1e0) AS ps, coalesce(sum(a) OVER w, 0e0) AS pa FROM c WINDOW w AS (PARTITION BY run ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run, frame_id, round(ps * s, 4) AS s, round(cos(pa + a), 4) + 0e0 AS r0, round(sum(ps * (cos(pa) * tx + sin(pa) * tz)) OVER w, 4) + 0e0 AS tx, round(sum(ps * (cos(pa) * tz - sin(pa) * tx)) OVER w, 4) + 0e0 AS tz FROM p WINDOW w AS (PARTITION BY run ORDER BY frame_id)""")
def r17(spark, d):
    rows = base(spark, d, "frames").selectExpr("cast(floor(frame_id / 9) as bigint) as run", "frame_id", "1e0 + frame_id % 5 / 2e1 as s", "frame_id * 3 % 20 / 1e1 as a", "x as tx", "z as tz")
    found = S.chained(rows.select("run", "frame_id", "s", "tx", F.lit(0.0).alias("ty"), "tz", *yaw("r", F.col("a"))), ["run"], "frame_id")
    return found.select("run", "frame_id", F.round("s", 4).alias("s"), *[(F.round(c, n) + 0.0).alias(c) for c, n in (("r0", 4), ("tx", 4), ("tz", 4))])


@register("p22_pose_errors", FRM + _VIEWS + """, e AS (SELECT i.visit, degrees(acos(greatest(-1e0, least(1e0, cos((i.ya - j.ya) - (i.yb - j.yb)))))) AS degrees FROM v i JOIN v j ON i.visit = j.visit AND i.frame_id < j.frame_id) SELECT visit, round(avg(degrees), 3) AS rot_mean, round(median(degrees), 3) AS rot_median FROM e GROUP BY 1""")
def p22(spark, d):
    pairs = S.pair_errors(_views(spark, d), ["visit"], "frame_id")
    return pairs.groupBy("visit").agg(F.round(F.avg("degrees"), 3).alias("rot_mean"), F.round(F.median("degrees"), 3).alias("rot_median"))


@register("h1_pose_scores", FRM + _VIEWS + """, o AS (SELECT v.visit, count(*) AS views, count(*) FILTER (WHERE degrees(acos(greatest(-1e0, least(1e0, cos(ya - yb - turn))))) < 3e0) AS views_ok FROM v JOIN m USING (visit) GROUP BY 1) SELECT visit, views, views_ok FROM o""")
def h1(spark, d):
    """Views of a set whose turn is near after one common turn."""
    return S.pose_scores(_views(spark, d), ["visit"], "frame_id", 3.0).select("visit", "views", "views_ok")


_SLERP = """, k AS (SELECT capture_id, frame_id AS t, CASE WHEN frame_id % 4 = 0 THEN struct_pack(t := frame_id, x := qx / q, y := qy / q, z := qz / q, w := qw / q) END AS p FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS q FROM frames)),
b AS (SELECT capture_id, t, last_value(p IGNORE NULLS) OVER back AS a, first_value(p IGNORE NULLS) OVER ahead AS b FROM k WINDOW back AS (PARTITION BY capture_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY capture_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT capture_id, t, coalesce(a, b) AS a, coalesce(b, a) AS b FROM b), e AS (SELECT *, a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w AS dot, coalesce((t - a.t) / CAST(nullif(b.t - a.t, 0) AS DOUBLE), 0e0) AS f FROM c), g AS (SELECT *, acos(least(abs(dot), 1e0)) AS h FROM e),
w AS (SELECT *, CASE WHEN sin(h) < 1e-9 THEN 1 - f ELSE sin((1 - f) * h) / sin(h) END AS wa, CASE WHEN sin(h) < 1e-9 THEN f ELSE sin(f * h) / sin(h) END * CASE WHEN dot < 0 THEN -1e0 ELSE 1e0 END AS wb FROM g)"""


@register("p26_slerp", FRM + _SLERP + " SELECT capture_id, t, round(wa * a.x + wb * b.x, 5) + 0e0 AS qx, round(wa * a.w + wb * b.w, 5) + 0e0 AS qw FROM w")
def p26_slerp(spark, d):
    known = F.col("frame_id") % 4 == 0
    rows = base(spark, d, "frames").select("capture_id", F.col("frame_id").alias("t"), *[F.when(known, F.col(c)).alias(c) for c in ("qx", "qy", "qz", "qw")])
    return S.gap_poses(rows, ["capture_id"]).select("capture_id", "t", (F.round("qx", 5) + 0.0).alias("qx"), (F.round("qw", 5) + 0.0).alias("qw"))


@register("j9_ratio_test", """ WITH e AS (SELECT vec_id, vec_id // 20 AS photo, embedding FROM embeddings), p AS (SELECT a.photo, a.vec_id AS a, b.vec_id AS b, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS d FROM e a JOIN e b ON b.photo = a.photo + 1),
x AS (SELECT *, row_number() OVER (PARTITION BY photo, a ORDER BY d, b) AS i, lead(d) OVER (PARTITION BY photo, a ORDER BY d, b) AS d2 FROM p) SELECT photo, a, b FROM x WHERE i = 1 AND d < 95e-2 * d2""")
def j9_ratio(spark, d):
    """Matches whose nearest neighbour is clearly nearer than the second one."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / 20).alias("photo"), F.col("embedding").cast("array<double>").alias("e"))
    left, right = e.select("photo", F.col("vec_id").alias("a"), F.col("e").alias("ea")), e.select((F.col("photo") - 1).alias("photo"), F.col("vec_id").alias("b"), F.col("e").alias("eb"))
    distance = F.sqrt(F.aggregate(F.zip_with("ea", "eb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return joins.ratio_matches(left.join(right, "photo").select("photo", "a", "b", F.round(distance, 9).alias("d")), ["photo"], 0.95)


_WALL = """, r AS (SELECT *, coalesce(lead(u) OVER w, first_value(u) OVER w) AS u2, coalesce(lead(v) OVER w, first_value(v) OVER w) AS v2 FROM corners WINDOW w AS (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), o AS (SELECT CAST(ring AS BIGINT) AS ring, i, CAST(i * 7 % 45 AS BIGINT) AS wall, i % 9 / 2e1 AS offset_, 8e-1 + i % 3 / 1e1 AS width FROM corners)"""


@register("j3_openings_on_walls", COR + _WALL + """ SELECT o.ring, o.i, round(r.u + (r.u2 - r.u) / greatest(sqrt((r.u2 - r.u) ** 2 + (r.v2 - r.v) ** 2), 1e-9) * offset_, 5) AS u0, round(r.v + (r.v2 - r.v) / greatest(sqrt((r.u2 - r.u) ** 2 + (r.v2 - r.v) ** 2), 1e-9) * (offset_ + width), 5) AS v1 FROM o LEFT JOIN r ON r.ring = o.ring AND r.i = o.wall""")
def j3(spark, d):
    """Ends of openings along their wall; null where the wall is not there."""
    corners = base(spark, d, "corners")
    walls = G.edges(corners, ["ring"]).withColumnRenamed("i", "wall").withColumn("ring", F.col("ring").cast("long"))
    openings = corners.selectExpr("cast(ring as bigint) as ring", "i", "cast(i * 7 % 45 as bigint) as wall", "i % 9 / 2e1 as offset", "8e-1 + i % 3 / 1e1 as width")
    return rounded(G.on_walls(openings, walls, ["ring", "wall"]).select("ring", "i", "u0", "v1"), "u0", "v1", digits=5)


@register("j17_polygon_overlap", REG + """, b AS (SELECT CAST(floor(d_ord / 12) AS BIGINT) AS plan, d_ord, length * 3e0 AS x0, area * 5e0 AS z0, length * 3e0 + 1e0 + d_ord % 4 AS x1, area * 5e0 + 1e0 + d_ord % 3 AS z1 FROM regions), p AS (SELECT a.plan, a.d_ord AS a, b.d_ord AS b, greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.z1, b.z1) - greatest(a.z0, b.z0)) / least((a.x1 - a.x0) * (a.z1 - a.z0), (b.x1 - b.x0) * (b.z1 - b.z0)) AS share FROM b a JOIN b ON a.plan = b.plan AND a.d_ord < b.d_ord) SELECT plan, a, b, round(share, 6) AS share FROM p WHERE round(share, 6) > 0""")
def j17(spark, d):
    """Overlap of every two rooms of a plan, over the smaller one, by their outlines."""
    rows = base(spark, d, "regions").selectExpr("cast(floor(d_ord / 12) as bigint) as plan", "d_ord as id", "length * 3e0 as x0", "area * 5e0 as z0", "length * 3e0 + 1e0 + d_ord % 4 as x1", "area * 5e0 + 1e0 + d_ord % 3 as z1")
    rooms = rows.select("plan", "id", F.array(F.array("x0", "z0"), F.array("x1", "z0"), F.array("x1", "z1"), F.array("x0", "z1")).alias("polygon"))
    return rounded(G.polygon_overlaps(rooms, ["plan"]).select("plan", "a", "b", "share"), "share").where("share > 0")


_SEEN = """, o AS (SELECT capture_id AS piece, frame_id % 40 AS frame, u AS idx, u, v, depth FROM points), t AS (SELECT piece, idx, avg(depth) + 1e0 AS z FROM o GROUP BY 1, 2), g AS (SELECT piece, frame, CAST(floor(u * 5e-1) AS INTEGER) AS pu, CAST(floor(v * 5e-1) AS INTEGER) AS pv, min(depth) AS d FROM o GROUP BY 1, 2, 3, 4),
q AS (SELECT o.piece, o.frame, median(g.d / t.z) AS ratio FROM o JOIN t USING (piece, idx) JOIN g ON g.piece = o.piece AND g.frame = o.frame AND g.pu = CAST(floor(o.u * 5e-1) AS INTEGER) AND g.pv = CAST(floor(o.v * 5e-1) AS INTEGER) WHERE t.z > 1e-6 GROUP BY 1, 2 HAVING count(*) >= 10)"""


@register("j18_piece_scales", PTS + _SEEN + " SELECT piece, round(median(ratio), 6) AS scale, count(*) AS frames FROM q GROUP BY 1")
def j18(spark, d):
    """Metric scale of each piece: depth under its seen points over their depth in the piece."""
    seen = base(spark, d, "points").selectExpr("capture_id as piece", "frame_id % 40 as frame", "u as idx", "u", "v", "depth")
    points = seen.groupBy("piece", "idx").agg((F.avg("depth") + 1.0).alias("z"))
    grid = seen.groupBy("piece", "frame", F.floor(F.col("u") * 0.5).cast("int").alias("pu"), F.floor(F.col("v") * 0.5).cast("int").alias("pv")).agg(F.min("depth").alias("d"))
    return rounded(joins.piece_scales(seen.drop("depth"), points, grid, 0.5), "scale")


@register("j23_piece_of_frame", FRM + """, p AS (SELECT capture_id, CAST(floor(frame_id / 50) AS BIGINT) AS piece, min(frame_id) AS first, max(frame_id) AS last FROM frames WHERE frame_id % 50 < 30 GROUP BY 1, 2) SELECT f.capture_id, f.frame_id, coalesce(p.piece, -1) AS piece FROM frames f LEFT JOIN p ON p.capture_id = f.capture_id AND f.frame_id BETWEEN p.first AND p.last""")
def j23(spark, d):
    """Piece of each frame, -1 where it was lost; pieces are spans, looked up by bucket."""
    rows = base(spark, d, "frames").select("capture_id", "frame_id")
    pieces = rows.where("frame_id % 50 < 30").groupBy("capture_id", F.floor(F.col("frame_id") / 50).alias("piece")).agg(F.min("frame_id").alias("start"), F.max("frame_id").alias("stop"))
    return joins.span_of(rows, pieces, "frame_id", ["capture_id"], 64).select("capture_id", "frame_id", F.coalesce("piece", F.lit(-1)).alias("piece"))


@register("r11_corrected", FRM + """, f AS (SELECT *, frame_id // 240 AS fragment FROM frames), g AS (SELECT fragment, avg(x) AS cx, avg(z) AS cz, fragment % 5 / 5e1 AS a, fragment % 3 / 1e1 AS tx FROM f GROUP BY fragment) SELECT frame_id, round(cos(a) * (x - cx) - sin(a) * (z - cz) + cx + tx, 5) AS x, round(sin(a) * (x - cx) + cos(a) * (z - cz) + cz, 5) AS z FROM f JOIN g USING (fragment)""")
def r11(spark, d):
    """Frames turned about their fragment's centre and shifted by its correction."""
    rows = base(spark, d, "frames").select("frame_id", F.floor(F.col("frame_id") / 240).alias("fragment"), "x", "z")
    moves = rows.groupBy("fragment").agg(F.avg("x").alias("cx"), F.avg("z").alias("cz")).withColumn("a", F.col("fragment") % 5 / 50.0).withColumn("tx", F.col("fragment") % 3 / 10.0).withColumn("tz", F.lit(0.0))
    return rounded(G.corrected(rows, moves, ["fragment"]).select("frame_id", "x", "z"), "x", "z", digits=5)


@register("a26_residuals", FRM + """, f AS (SELECT capture_id, frame_id, x, z, sqrt((x - z) ** 2 + 1e-2) AS before, sqrt((x - z) ** 2 * 25e-2 + 1e-2) AS after FROM frames) SELECT capture_id, round(median(before) * 100, 4) AS before_cm, round(median(after) * 100, 4) AS after_cm FROM f GROUP BY 1""")
def a26(spark, d):
    """Median misfit of revisits before and after correction."""
    rows = base(spark, d, "frames").selectExpr("capture_id", "x - z as dx", "1e-1 as dz", "(x - z) * 5e-1 as ex", "1e-1 as ez")
    gap = lambda a, b: F.round(F.median(F.hypot(F.col(a), F.col(b))) * 100, 4)
    return rows.groupBy("capture_id").agg(gap("dx", "dz").alias("before_cm"), gap("ex", "ez").alias("after_cm"))


@register("r16_subtree_shift", FRM.replace("WITH", "WITH RECURSIVE", 1) + """, t AS (SELECT frame_id AS node, CASE WHEN frame_id % 32 > 0 THEN CAST(floor(frame_id / 32) * 32 + floor((frame_id % 32 - 1) / 2) AS BIGINT) END AS parent, x AS delta FROM frames), r AS (SELECT node, delta AS shift FROM t WHERE parent IS NULL OR parent NOT IN (SELECT node FROM t) UNION ALL SELECT t.node, r.shift + t.delta FROM t JOIN r ON t.parent = r.node) SELECT node, round(shift, 5) AS shift FROM r""")
def r16(spark, d):
    """Shift of every room by its own move and those of all rooms it hangs on."""
    parent = F.when(F.col("frame_id") % 32 > 0, (F.floor(F.col("frame_id") / 32) * 32 + F.floor((F.col("frame_id") % 32 - 1) / 2)).cast("long"))
    moves = base(spark, d, "frames").select(F.col("frame_id").alias("node"), parent.alias("parent"), F.col("x").alias("shift"))
    return rounded(graph.path_sums(moves, "shift"), "shift", digits=5)


_DIST = "abs(atan2(sin(c.yaw - p.yaw), cos(c.yaw - p.yaw))) / pi() + 25e-2 * sqrt((c.x - p.x) ** 2 + (c.z - p.z) ** 2)"


@register("r21_spread_views", FRM.replace("WITH", "WITH RECURSIVE", 1) + f""", c AS (SELECT CAST(floor(frame_id / 30) AS BIGINT) AS room, list(struct_pack(id := frame_id, yaw := frame_id * 7 % 60 / 1e1, x := x, z := z, sharp := price) ORDER BY price DESC, frame_id) AS cands FROM frames GROUP BY 1),
r AS (SELECT room, 1 AS n, [cands[1]] AS picks FROM c UNION ALL SELECT room, n + 1, list_append(picks, cands[list_position(ds, list_max(ds))]) FROM (SELECT c.room, r.n, r.picks, c.cands, list_transform(c.cands, lambda c: round(list_min(list_transform(r.picks, lambda p: {_DIST})), 9)) AS ds FROM r JOIN c ON c.room = r.room WHERE r.n < 5 AND r.n < len(c.cands)))
SELECT room, i, picks[i].id AS frame_id FROM (SELECT room, picks, unnest(range(1, len(picks) + 1)) AS i FROM r WHERE n = (SELECT max(n) FROM r q WHERE q.room = r.room))""")
def r21(spark, d):
    """Five views of a room, each the farthest in direction and place from those before, the sharpest first."""
    rows = base(spark, d, "frames").selectExpr("cast(floor(frame_id / 30) as bigint) as room", "frame_id", "frame_id * 7 % 60 / 1e1 as yaw", "x", "z", "price as sharp")
    return graph.spread_views(rows, "room", "frame_id", 5)


_BANDS = """, b AS (SELECT frame_id % 30 * 10 + CAST(least(floor(y / 28e-2), 9) AS BIGINT) AS region, x, y, z FROM points), m AS (SELECT region, median(y) AS h, median(x) AS mx, median(z) AS mz, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 5), w AS (SELECT * FROM (VALUES ('r.w1', 1e0, -6e0, 1e0, 6e0), ('r.w2', -6e0, 2e0, 6e0, 2e0), ('r.w3', -3e0, -6e0, -3e0, 0e0)) t(wall, ax, az, bx, bz)),
q AS (SELECT m.*, w.*, sqrt((bx - ax) ** 2 + (bz - az) ** 2) AS l, greatest(0e0, least(1e0, ((mx - ax) * (bx - ax) + (mz - az) * (bz - az)) / ((bx - ax) ** 2 + (bz - az) ** 2))) AS t FROM m, w), k AS (SELECT *, sqrt((mx - ax - t * (bx - ax)) ** 2 + (mz - az - t * (bz - az)) ** 2) AS far FROM q), o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(far, 9), wall) AS i FROM k),
s AS (SELECT region, n, h, CASE WHEN h < 15e-2 THEN 'floor' WHEN abs(h - 25e-1) < 15e-2 THEN 'ceiling' WHEN far <= 15e-1 THEN 'wall' END AS kind, CASE WHEN h < 15e-2 THEN 'r.floor' WHEN abs(h - 25e-1) < 15e-2 THEN 'r.ceiling' WHEN far <= 15e-1 THEN wall END AS surface_id, ax, az, (bx - ax) / l AS ux, (bz - az) / l AS uz FROM o WHERE i = 1)"""


@register("r25_projected_damage", PTS + _BANDS + """, f AS (SELECT s.region, kind, surface_id, n, CASE WHEN kind = 'wall' THEN (x - ax) * ux + (z - az) * uz ELSE x END AS a, CASE WHEN kind = 'wall' THEN y ELSE z END AS b, h FROM s JOIN b USING (region) WHERE kind IS NOT NULL)
SELECT region, kind, surface_id, n, round(quantile_cont(a, 95e-2) - quantile_cont(a, 5e-2), 6) AS width, round(quantile_cont(b, 95e-2) - quantile_cont(b, 5e-2), 6) AS height, round(CASE WHEN kind = 'wall' THEN quantile_cont(b, 5e-2) WHEN kind = 'floor' THEN 0e0 ELSE any_value(h) END, 6) + 0e0 AS bottom FROM f GROUP BY region, kind, surface_id, n""")
def r25(spark, d):
    rows = base(spark, d, "points").selectExpr("frame_id % 30 * 10 + cast(least(floor(y / 28e-2), 9) as bigint) as region", "x", "y", "z")
    walls = [("r.w1", 1.0, -6.0, 1.0, 6.0), ("r.w2", -6.0, 2.0, 6.0, 2.0), ("r.w3", -3.0, -6.0, -3.0, 0.0)]
    rooms = rows.select("region").distinct().withColumns({"room": F.lit("r"), "ceiling": F.lit(2.5), "walls": F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(w, ("wall", "ax", "az", "bx", "bz"), strict=True)]) for w in walls])})
    return damage.projected(rows, rooms, "region", least=5, far=1.5, digits=6).select("region", "kind", "surface_id", "n", "width", "height", "bottom")


_NAMES = "SELECT capture_id, frame_id % 6 AS piece, frame_id, price AS inliers FROM frames"


@register("t2_ranked_candidates", FRM + " SELECT capture_id, frame_id, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY price DESC, frame_id) AS INTEGER) AS rank FROM frames")
def t2(spark, d):
    return base(spark, d, "frames").select("capture_id", "frame_id", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("price"), "frame_id")).alias("rank"))


@register("t3_by_confidence", BOX + " SELECT image, box_id, x0, y0, score, CAST(rank() OVER (PARTITION BY image, class ORDER BY score DESC) AS INTEGER) AS rank FROM boxes")
def t3(spark, d):
    return base(spark, d, "boxes").select("image", "box_id", "x0", "y0", "score", F.rank().over(Window.partitionBy("image", "class").orderBy(F.desc("score"))).alias("rank"))


@register("t4_pieces", FRM + f""", p AS (SELECT capture_id, piece, count(*) AS size, min(frame_id) AS first FROM ({_NAMES}) GROUP BY 1, 2) SELECT capture_id, piece, size, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY size DESC, first) AS INTEGER) AS by_size, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY first) AS INTEGER) AS by_time FROM p""")
def t4(spark, d):
    pieces = base(spark, d, "frames").groupBy("capture_id", (F.col("frame_id") % 6).alias("piece")).agg(F.count("*").alias("size"), F.min("frame_id").alias("first"))
    w = Window.partitionBy("capture_id")
    return pieces.select("capture_id", "piece", "size", F.row_number().over(w.orderBy(F.desc("size"), "first")).alias("by_size"), F.row_number().over(w.orderBy("first")).alias("by_time"))


@register("t6_best_seed", FRM + f""", p AS (SELECT capture_id, piece, count(*) AS n FROM ({_NAMES}) GROUP BY 1, 2) SELECT capture_id, piece AS seed, n FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, piece) AS i FROM p) WHERE i = 1""")
def t6(spark, d):
    seeds = base(spark, d, "frames").groupBy("capture_id", (F.col("frame_id") % 6).alias("seed")).agg(F.count("*").alias("n"))
    return seeds.groupBy("capture_id").agg(F.max_by("seed", F.struct("n", -F.col("seed"))).alias("seed"), F.max("n").alias("n"))


@register("t7_outermost", FRM + " SELECT capture_id, arg_min(frame_id, struct_pack(a := x, b := frame_id)) AS low, arg_max(frame_id, struct_pack(a := x, b := -frame_id)) AS high FROM frames GROUP BY 1")
def t7(spark, d):
    return base(spark, d, "frames").groupBy("capture_id").agg(F.min_by("frame_id", F.struct("x", "frame_id")).alias("low"), F.max_by("frame_id", F.struct("x", -F.col("frame_id"))).alias("high"))


@register("t8_best_group", FRM + f""", p AS (SELECT capture_id, piece, count(*) AS n, round(sum(inliers), 2) AS total FROM ({_NAMES}) GROUP BY 1, 2) SELECT capture_id, piece, n, total FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, total DESC, piece) AS i FROM p) WHERE i = 1""")
def t8(spark, d):
    groups = base(spark, d, "frames").groupBy("capture_id", (F.col("frame_id") % 6).alias("piece")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
    best = groups.groupBy("capture_id").agg(F.max(F.struct("n", "total", (-F.col("piece")).alias("p"))).alias("m"))
    return best.select("capture_id", (-F.col("m.p")).alias("piece"), "m.n", "m.total")


@register("u5_warnings_in_order", REG + """, w AS (SELECT room_id, 1 AS part, d_ord, concat('no height ', CAST(d_ord AS VARCHAR)) AS text FROM regions WHERE bottom IS NULL UNION ALL SELECT room_id, 2, d_ord, concat('no ceiling ', CAST(d_ord AS VARCHAR)) FROM regions WHERE ceiling IS NULL) SELECT room_id, string_agg(text, '; ' ORDER BY part, d_ord) AS warnings FROM w GROUP BY 1""")
def u5(spark, d):
    rows = base(spark, d, "regions")
    part = lambda k, missing, text: rows.where(F.col(missing).isNull()).select("room_id", F.lit(k).alias("part"), "d_ord", F.concat(F.lit(text), F.col("d_ord").cast("string")).alias("text"))
    both = part(1, "bottom", "no height ").unionByName(part(2, "ceiling", "no ceiling "))
    return both.groupBy("room_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d_ord", "text"))), lambda w: w["text"]), "; ").alias("warnings"))
