"""Walls, outlines, ceilings, cells and views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planspark.functions import scalars as X
from planspark.operators import geometry as G
from planspark.operators import points as P
from planspark.operators import walls as W
from planspark.plans.aggregates import rounded
from planspark.plans.bases import base, cte
from planspark.plans.registry import register

PTS, FRM, REG, COR, PIX = (cte(n) for n in ("points", "frames", "regions", "corners", "pixels"))

_TURNED = "cos(radians(degree)) * x + sin(radians(degree)) * z AS u, cos(radians(degree)) * z - sin(radians(degree)) * x AS v"


def _scores(name: str, angles: str) -> str:
    return f"""{name}_t AS (SELECT capture_id, degree, {_TURNED} FROM {angles}), {name}_h AS (SELECT capture_id, degree, 0 AS axis, floor(u / 5e-2) AS bin, count(*) AS n FROM {name}_t GROUP BY 1, 2, 3, 4 UNION ALL SELECT capture_id, degree, 1, floor(v / 5e-2), count(*) FROM {name}_t GROUP BY 1, 2, 3, 4),
{name}_s AS (SELECT capture_id, degree, CAST(sum(n * n) AS BIGINT) AS score FROM {name}_h GROUP BY 1, 2), {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, degree) AS i FROM {name}_s) WHERE i = 1)"""


@register("a8_dominant_angle", PTS + ", " + _scores("rough", "points, (SELECT unnest(range(0, 90)) * 1e0 AS degree)") + ", " + _scores("fine", "(SELECT p.capture_id, x, z, r.degree + (-1e0 + k * 5e-2) AS degree FROM points p JOIN rough r USING (capture_id), (SELECT unnest(range(0, 40)) AS k))") + """
SELECT r.capture_id, round(CASE WHEN f.score > r.score THEN f.degree ELSE r.degree END, 2) AS degree FROM rough r JOIN fine f USING (capture_id)""")
def a8(spark, d):
    return rounded(W.dominant_angle(base(spark, d, "points"), "capture_id", 0.05), "degree", digits=2)


_EDGES = ", r AS (SELECT *, coalesce(lead(u) OVER w, first_value(u) OVER w) AS u2, coalesce(lead(v) OVER w, first_value(v) OVER w) AS v2 FROM corners WINDOW w AS (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_RECT = _EDGES + """, e AS (SELECT ring, row_number() OVER (PARTITION BY ring ORDER BY i) AS k, CASE WHEN abs(u2 - u) < abs(v2 - v) THEN 0 ELSE 1 END AS axis, CASE WHEN abs(u2 - u) < abs(v2 - v) THEN (u + u2) / 2 ELSE (v + v2) / 2 END AS c, CASE WHEN abs(u2 - u) < abs(v2 - v) THEN v ELSE u END AS s, CASE WHEN abs(u2 - u) < abs(v2 - v) THEN v2 ELSE u2 END AS t FROM r WHERE sqrt((u2 - u) ** 2 + (v2 - v) ** 2) >= 3e-1),
f AS (SELECT ring, k, 1 AS g, axis, c, s, t FROM e WHERE k = 1 UNION ALL SELECT e.ring, e.k, CASE WHEN e.axis = f.axis THEN f.g ELSE f.g + 1 END, e.axis, CASE WHEN e.axis = f.axis THEN (f.c + e.c) / 2 ELSE e.c END, CASE WHEN e.axis = f.axis THEN f.s ELSE e.s END, e.t FROM f JOIN e ON e.ring = f.ring AND e.k = f.k + 1),
l AS (SELECT ring, g, arg_max(axis, k) AS axis, arg_max(c, k) AS c, arg_max(s, k) AS s, arg_max(t, k) AS t, max(g) OVER (PARTITION BY ring) AS n FROM f GROUP BY ring, g),
q AS (SELECT a.ring, a.n, a.axis = b.axis AND a.n > 1 AS wrap, (b.c + a.c) / 2 AS c, b.s FROM l a JOIN l b ON a.ring = b.ring AND a.g = 1 AND b.g = b.n),
w AS (SELECT l.ring, CAST(l.g - 1 AS INTEGER) AS k, l.axis, CASE WHEN l.g = 1 AND q.wrap THEN q.c ELSE l.c END AS c, CASE WHEN l.g = 1 AND q.wrap THEN q.s ELSE l.s END AS s, l.t AS e FROM l JOIN q ON q.ring = l.ring WHERE NOT (q.wrap AND l.g = l.n))"""
REC = COR.replace("WITH", "WITH RECURSIVE", 1) + _RECT


def _rect(spark, d):
    return W.rectilinear(G.edges(base(spark, d, "corners"), ["ring"]), ["ring"])


@register("w8_rectilinear", REC + " SELECT ring, k, axis, round(c, 6) AS c, round(s, 6) AS s, round(e, 6) AS e FROM w")
def w8(spark, d):
    return rounded(_rect(spark, d), "c", "s", "e")


@register("r6_room_corners", REC + """, m AS (SELECT *, coalesce(lead(axis) OVER x, first_value(axis) OVER x) AS a2, coalesce(lead(c) OVER x, first_value(c) OVER x) AS c2 FROM w WINDOW x AS (PARTITION BY ring ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT ring, row_number() OVER (PARTITION BY ring ORDER BY k) AS i, CASE WHEN axis = 0 THEN c ELSE c2 END AS u, CASE WHEN axis = 0 THEN c2 ELSE c END AS v FROM m WHERE axis <> a2),
o AS (SELECT *, coalesce(lead(u) OVER x, first_value(u) OVER x) AS u2, coalesce(lead(v) OVER x, first_value(v) OVER x) AS v2 FROM p WINDOW x AS (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), t AS (SELECT *, sum(u * v2 - v * u2) OVER (PARTITION BY ring) AS area, count(*) OVER (PARTITION BY ring) AS n FROM o)
SELECT ring, CAST(CASE WHEN area < 0 AND n >= 3 THEN n - i ELSE i - 1 END AS INTEGER) AS i, round(u, 6) AS u, round(v, 6) AS v FROM t""")
def r6(spark, d):
    return rounded(W.corners(_rect(spark, d).withColumnRenamed("c", "pos"), ["ring"]), "u", "v")


_SIDES = [(0, 0, -4.0, -4.5, 4.5, 1.0), (1, 0, 3.5, 4.5, -4.5, -1.0), (2, 1, -3.0, -4.5, 4.5, 1.0), (3, 1, 4.2, -4.9, -4.8, -1.0)]
_SIDE = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, {axis}, {c}e0, {s}e0, {e}e0, {sign}e0)" for k, axis, c, s, e, sign in _SIDES) + ") t(k, axis, c, s, e, sign))"


@register("a11_wall_fit", PTS + f""", g AS (SELECT capture_id, s.* FROM (SELECT DISTINCT capture_id FROM points), {_SIDE} s), n AS (SELECT p.capture_id, k, c, CASE WHEN axis = 0 THEN x ELSE z END AS p FROM points p JOIN g USING (capture_id) WHERE y > 3e-1 AND y < 2e0 AND CASE WHEN axis = 0 THEN z ELSE x END > least(s, e) + 1e-1 AND CASE WHEN axis = 0 THEN z ELSE x END < greatest(s, e) - 1e-1 AND (CASE WHEN axis = 0 THEN x ELSE z END - c) * sign > -15e-2 AND (CASE WHEN axis = 0 THEN x ELSE z END - c) * sign < 1e-1),
h AS (SELECT capture_id, k, floor((p - (c - 25e-2)) / 1e-2) AS bin, count(*) AS n FROM n GROUP BY 1, 2, 3), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, k ORDER BY n DESC, bin) AS i FROM h) WHERE i = 1), s AS (SELECT capture_id, k, count(*) AS seen FROM n GROUP BY 1, 2),
l AS (SELECT n.capture_id, n.k, median(p) AS pos, 12533e-4 * stddev_pop(p) / sqrt(count(*)) AS sigma, count(*) AS n FROM n JOIN t ON t.capture_id = n.capture_id AND t.k = n.k WHERE abs(p - (c - 25e-2 + t.bin * 1e-2 + 5e-3)) < 2e-2 GROUP BY 1, 2)
SELECT g.capture_id, CAST(g.k AS INTEGER) AS k, round(CASE WHEN seen >= 50 THEN pos ELSE c END, 6) AS pos, round(CASE WHEN seen >= 50 THEN sigma ELSE 5e-2 END, 6) AS sigma, CASE WHEN seen >= 50 THEN l.n ELSE coalesce(seen, 0) END AS n FROM g LEFT JOIN s ON s.capture_id = g.capture_id AND s.k = g.k LEFT JOIN l ON l.capture_id = g.capture_id AND l.k = g.k""")
def a11(spark, d):
    rows = base(spark, d, "points")
    sides = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("k", "axis", "c", "s", "e", "sign"), strict=True)]) for s in _SIDES])
    edges = rows.select("capture_id").distinct().select("capture_id", F.explode(sides).alias("x")).select("capture_id", "x.*")
    walls = W.fitted(edges, rows.where("y > 3e-1 and y < 2e0").selectExpr("capture_id", "x as u", "z as v"), ["capture_id"])
    return rounded(walls.select("capture_id", "k", "pos", "sigma", "n"), "pos", "sigma")


@register("h6_wall_support", PTS + f""", g AS (SELECT capture_id, s.* FROM (SELECT DISTINCT capture_id FROM points), {_SIDE} s WHERE k < 3), n AS (SELECT p.capture_id, count(*) AS support FROM points p JOIN g USING (capture_id) WHERE y > 3e-1 AND y < 2e0 AND CASE WHEN axis = 0 THEN z ELSE x END > least(s, e) + 1e-1 AND CASE WHEN axis = 0 THEN z ELSE x END < greatest(s, e) - 1e-1 AND abs(CASE WHEN axis = 0 THEN x ELSE z END - c) < 1e-1 GROUP BY 1)
SELECT p.capture_id, any_value(n.support) AS support, round(greatest(max(x) - min(x), max(z) - min(z)), 6) AS spread, round(least(max(x) - min(x), max(z) - min(z)), 6) AS narrow FROM points p JOIN n USING (capture_id) GROUP BY 1""")
def h6(spark, d):
    rows = base(spark, d, "points")
    sides = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("k", "axis", "c", "s", "e", "sign"), strict=True)]) for s in _SIDES[:3]])
    along, across = F.when(F.col("w.axis") == 0, F.col("z")).otherwise(F.col("x")), F.when(F.col("w.axis") == 0, F.col("x")).otherwise(F.col("z"))
    near = rows.where("y > 3e-1 and y < 2e0").withColumn("w", F.explode(sides)).where((along > F.least("w.s", "w.e") + 0.1) & (along < F.greatest("w.s", "w.e") - 0.1) & (F.abs(across - F.col("w.c")) < 0.1))
    support = near.groupBy("capture_id").agg(F.count("*").alias("support"))
    box = G.box_sides(rows.selectExpr("capture_id", "x as u", "z as v"), ["capture_id"])
    return rounded(box.join(support, "capture_id").selectExpr("capture_id", "support", "long as spread", "short as narrow"), "spread", "narrow")


@register("a12_manhattan_box", PTS + """, b AS (SELECT capture_id, x AS u, z AS v, y AS h FROM points WHERE y > 2e-1 AND y < 18e-1), x AS (SELECT capture_id, greatest(quantile_cont(u, 98e-2) - quantile_cont(u, 2e-2), 5e-1) AS lu, greatest(quantile_cont(v, 98e-2) - quantile_cont(v, 2e-2), 5e-1) AS lv, min(u) AS minu, min(v) AS minv FROM b GROUP BY 1 HAVING count(*) >= 200),
s AS (SELECT capture_id, h, 0 AS axis, u AS p, v AS q, lv AS length, minu AS low FROM b JOIN x USING (capture_id) UNION ALL SELECT capture_id, h, 1, v, u, lu, minv FROM b JOIN x USING (capture_id)), o AS (SELECT *, floor((p - (low - 2e-1)) / 2e-1) AS own FROM s),
t AS (SELECT DISTINCT capture_id, axis, own FROM o), g AS (SELECT o.capture_id, o.axis, t.own AS bin, count(*) AS n, count(DISTINCT least(greatest(floor((h - 2e-1) / 1e-1), 0), 15)) AS bands, count(DISTINCT floor(q / 1e-1)) AS tenths, any_value(length) AS length, median(p) AS c FROM o JOIN t ON t.capture_id = o.capture_id AND t.axis = o.axis AND o.own BETWEEN t.own - 1 AND t.own + 1 GROUP BY 1, 2, 3),
w AS (SELECT * FROM g WHERE n >= 30 AND bands / 16e0 >= 25e-2 AND tenths * 1e-1 >= 4e-1 * length), m AS (SELECT capture_id, axis, min(CASE WHEN c < 25e-2 THEN c END) AS lo, max(CASE WHEN c > 25e-2 THEN c END) AS hi FROM w GROUP BY 1, 2)
SELECT capture_id, CAST(axis AS INTEGER) AS axis, round(lo, 6) AS lo, round(hi, 6) AS hi FROM m WHERE lo IS NOT NULL AND hi IS NOT NULL""")
def a12(spark, d):
    rows = base(spark, d, "points")
    band = rows.where("y > 2e-1 and y < 18e-1").selectExpr("capture_id", "x as u", "z as v", "y as h")
    centres = rows.select("capture_id").distinct().selectExpr("capture_id", "25e-2 as cu", "25e-2 as cv")
    return rounded(W.outermost(band, centres, ["capture_id"], size=0.2), "lo", "hi")


def _level(name: str, rows: str, res: str, half: str, share: str) -> str:
    return f"""{name}_a AS (SELECT capture_id FROM {rows} GROUP BY 1 HAVING count(*) >= 200), {name}_t AS (SELECT capture_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bin) AS i FROM (SELECT capture_id, floor((y - 19e-1) / {res}) AS bin, count(*) AS n FROM {rows} GROUP BY 1, 2)) WHERE i = 1),
{name} AS (SELECT r.capture_id, median(y) AS level, 12533e-4 * stddev_pop(y) / sqrt(count(*)) AS sigma FROM {rows} r JOIN {name}_a USING (capture_id) JOIN {name}_t t USING (capture_id) WHERE abs(y - (19e-1 + t.bin * {res} + {res} / 2)) < {half} GROUP BY 1 HAVING count(*) * 9e-2 >= {share} * (1e0 + any_value(r.capture_id) * 2e0))"""


@register("a10_room_ceiling", PTS + ", up AS (SELECT capture_id, y FROM points WHERE y > 19e-1 AND y < 4e0), " + _level("f", "up", "1e-2", "2e-2", "4e-1") + ", rest AS (SELECT up.* FROM up JOIN f USING (capture_id) WHERE abs(y - level) > 15e-2), " + _level("s", "rest", "5e-2", "3e-2", "25e-2") + """
SELECT c.capture_id, round(f.level, 6) AS level, round(f.sigma, 6) AS sigma, round(s.level, 6) AS second FROM (SELECT DISTINCT capture_id FROM points) c LEFT JOIN f USING (capture_id) LEFT JOIN s USING (capture_id)""")
def a10(spark, d):
    rows = base(spark, d, "points")
    rooms = rows.select("capture_id").distinct().selectExpr("capture_id", "1e0 + capture_id * 2e0 as area")
    return rounded(W.ceilings(rows.selectExpr("capture_id", "y as h"), rooms, ["capture_id"], 0.3), "level", "sigma", "second")


@register("e7_room_records", COR + """, s AS (SELECT *, 5e-3 * (1 + i % 4) AS sigma, row_number() OVER (PARTITION BY ring ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY ring) AS n FROM corners), w AS (SELECT a.ring, a.u, a.v, b.u AS u2, b.v AS v2, sqrt((b.u - a.u) ** 2 + (b.v - a.v) ** 2) AS length, a.sigma * a.sigma + c.sigma * c.sigma + 2e0 * 1e-2 * 1e-2 AS noise FROM s a JOIN s b ON b.ring = a.ring AND b.k = (a.k + 1) % a.n JOIN s c ON c.ring = a.ring AND c.k = (a.k + 2) % a.n),
g AS (SELECT ring, count(*) AS n, sum(length) AS p, sqrt(sum(noise + (5e-2 * length) ** 2)) AS ps, sum(noise) AS noise, abs(sum(u * v2 - v * u2) / 2) AS a FROM w GROUP BY 1), t AS (SELECT *, sqrt((sqrt(noise) * sqrt(a) / 2) ** 2 + (2e0 * 5e-2 * a) ** 2) AS sa FROM g)
SELECT ring, CAST(n AS INTEGER) AS walls, round(p, 4) AS perimeter, round(p - 1645e-3 * ps, 4) AS p_lo, round(p + 1645e-3 * ps, 4) AS p_hi, round(a, 4) AS area, round(a - 1645e-3 * sa, 4) AS a_lo, round(a + 1645e-3 * sa, 4) AS a_hi FROM t""")
def e7(spark, d):
    rooms = W.records(base(spark, d, "corners").withColumn("sigma", 0.005 * (1 + F.col("i") % 4)), ["ring"], 0.01, 0.05)
    return rooms.selectExpr("ring", "size(walls) as walls", "perimeter.value as perimeter", "perimeter.lo as p_lo", "perimeter.hi as p_hi", "floor_area.value as area", "floor_area.lo as a_lo", "floor_area.hi as a_hi")


_CELLS = ", c AS (SELECT DISTINCT capture_id, CAST(floor(x / 25e-2) AS BIGINT) AS col, CAST(floor(z / 25e-2) AS BIGINT) AS \"row\" FROM points WHERE y > 1e0)"
_ROUND = "(SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in G.ellipse(2)) + ") t(a, b))"


def _cells(spark, d):
    return P.raster(base(spark, d, "points").where("y > 1e0"), 0.25, ["capture_id"])


@register("r1_opened_cells", PTS + _CELLS + f""", e AS (SELECT capture_id, col + a AS col, "row" + b AS "row" FROM c, {_ROUND} o GROUP BY 1, 2, 3 HAVING count(*) = {len(G.ellipse(2))}) SELECT DISTINCT capture_id, col + a AS col, "row" + b AS "row" FROM e, {_ROUND} o""")
def r1_open(spark, d):
    return G.open_(_cells(spark, d), G.ellipse(2), ["capture_id"])


@register("r24_hull", PTS + _CELLS + """, x AS (SELECT capture_id, col, min("row") AS lo, max("row") AS hi FROM c GROUP BY 1, 2), k AS (SELECT p.capture_id, p.col, p.lo AS "row", 'lower' AS side FROM x p WHERE NOT EXISTS (SELECT 1 FROM x a, x b WHERE a.capture_id = p.capture_id AND b.capture_id = p.capture_id AND a.col < p.col AND p.col < b.col AND (b.col - a.col) * (p.lo - a.lo) >= (b.lo - a.lo) * (p.col - a.col)))
SELECT * FROM k UNION ALL SELECT p.capture_id, p.col, p.hi, 'upper' FROM x p WHERE NOT EXISTS (SELECT 1 FROM x a, x b WHERE a.capture_id = p.capture_id AND b.capture_id = p.capture_id AND a.col < p.col AND p.col < b.col AND (b.col - a.col) * (p.hi - a.hi) <= (b.hi - a.hi) * (p.col - a.col))""")
def r24(spark, d):
    return G.hull(_cells(spark, d), "capture_id")


@register("r3_enclosed", PTS.replace("WITH", "WITH RECURSIVE", 1) + """, c AS (SELECT DISTINCT capture_id, CAST(floor(x / 25e-2) AS BIGINT) AS col, CAST(floor(z / 25e-2) AS BIGINT) AS "row" FROM points WHERE y > 2e0), g AS (SELECT capture_id, col, "row" FROM (SELECT DISTINCT capture_id FROM c), (SELECT unnest(range(-20, 20)) AS col), (SELECT unnest(range(-20, 20)) AS "row")), f AS (SELECT * FROM g EXCEPT SELECT * FROM c),
r AS (SELECT * FROM f WHERE col IN (-8, 8) AND "row" IN (-8, 8) UNION SELECT f.* FROM r JOIN f ON f.capture_id = r.capture_id AND abs(f.col - r.col) + abs(f."row" - r."row") = 1) SELECT * FROM r""")
def r3(spark, d):
    """Free cells that a flood from four places reaches, between the cells of high points."""
    walls = P.raster(base(spark, d, "points").where("y > 2e0"), 0.25, ["capture_id"]).drop("n")
    span = F.sequence(F.lit(-20).cast("long"), F.lit(19).cast("long"))
    grid = walls.select("capture_id").distinct().withColumn("col", F.explode(span)).withColumn("row", F.explode(span))
    free = grid.join(walls, ["capture_id", "col", "row"], "left_anti")
    seeds = free.where("col in (-8, 8) and row in (-8, 8)")
    return G.flooded(free, seeds, ["capture_id"])


@register("p2_poses", FRM + """, n AS (SELECT frame_id, x AS tx, z AS tz, qx / q AS x, qy / q AS y, qz / q AS z, qw / q AS w FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS q FROM frames)) SELECT frame_id, round(1 - 2 * (y * y + z * z), 6) + 0e0 AS m0, round(2 * (x * y - z * w), 6) + 0e0 AS m1, round(2 * (x * z + y * w), 6) + 0e0 AS m2, round(tx, 6) AS m3, round(2 * (x * y + z * w), 6) + 0e0 AS m4, round(1 - 2 * (x * x + z * z), 6) + 0e0 AS m5, round(2 * (y * z - x * w), 6) + 0e0 AS m6, 15e-1 AS m7,
round(2 * (x * z - y * w), 6) + 0e0 AS m8, round(2 * (y * z + x * w), 6) + 0e0 AS m9, round(1 - 2 * (x * x + y * y), 6) + 0e0 AS m10, round(tz, 6) AS m11 FROM n""")
def p2(spark, d):
    """Twelve row-major entries of each frame's pose."""
    r = X.rotation(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    m = [*r[:3], F.col("x"), *r[3:6], F.lit(1.5), *r[6:], F.col("z")]
    return base(spark, d, "frames").select("frame_id", *[(F.round(e, 6) + 0.0).alias(f"m{i}") for i, e in enumerate(m)])


@register("p6_cell_centres", PTS + """ SELECT DISTINCT CAST(floor((x + 6e0) / 3e-1) AS BIGINT) AS col, CAST(floor((z + 6e0) / 3e-1) AS BIGINT) AS "row", round((floor((x + 6e0) / 3e-1) + 5e-1) * 3e-1 - 6e0, 6) AS u, round((floor((z + 6e0) / 3e-1) + 5e-1) * 3e-1 - 6e0, 6) AS v FROM points""")
def p6(spark, d):
    cells = base(spark, d, "points").select(X.cell(F.col("x"), 0.3, -6.0).alias("col"), X.cell(F.col("z"), 0.3, -6.0).alias("row")).distinct()
    return rounded(cells.withColumn("u", X.cell_centre(F.col("col"), 0.3, -6.0)).withColumn("v", X.cell_centre(F.col("row"), 0.3, -6.0)), "u", "v")


@register("p11_moved_rooms", COR + " SELECT ring, i, round(v * -1e0 + (2e0 + ring), 4) + 0e0 AS u, round(u * 1e0 - 1e0, 4) + 0e0 AS v FROM corners")
def p11(spark, d):
    """Rooms as nested arrays, turned by a quarter and shifted in place."""
    rooms = base(spark, d, "corners").groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("i", "u", "v"))).alias("polygon"))
    moved = rooms.withColumn("polygon", X.moved("polygon", F.lit(0.0), F.lit(1.0), 2.0 + F.col("ring"), F.lit(-1.0)))
    return moved.select("ring", F.explode("polygon").alias("p")).select("ring", "p.i", (F.round("p.u", 4) + 0.0).alias("u"), (F.round("p.v", 4) + 0.0).alias("v"))


_AXIS = _EDGES + """, m AS (SELECT ring, avg(u) AS mu, avg(v) AS mv FROM corners GROUP BY 1), x AS (SELECT r.ring, r.i, CASE WHEN abs(u2 - u) < abs(v2 - v) THEN 0 ELSE 1 END AS axis, CASE WHEN abs(u2 - u) < abs(v2 - v) THEN (u + u2) / 2 ELSE (v + v2) / 2 END AS c, CASE WHEN abs(u2 - u) < abs(v2 - v) THEN least(v, v2) ELSE least(u, u2) END AS lo, CASE WHEN abs(u2 - u) < abs(v2 - v) THEN greatest(v, v2) ELSE greatest(u, u2) END AS hi, mu, mv FROM r JOIN m USING (ring) WHERE sqrt((u2 - u) ** 2 + (v2 - v) ** 2) >= 3e-1),
a AS (SELECT ring, i, axis, c, lo, hi, CASE WHEN c > CASE WHEN axis = 0 THEN mu ELSE mv END THEN 1 ELSE -1 END AS sign FROM x)"""


@register("p14_facing_edges", COR + _AXIS + " SELECT ring, i, CAST(axis AS INTEGER) AS axis, round(c, 6) AS c, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(sign AS INTEGER) AS sign FROM a")
def p14(spark, d):
    return rounded(G.axis_edges(base(spark, d, "corners"), ["ring"]).drop("u", "v"), "c", "lo", "hi")


@register("j16_facing_walls", COR + _AXIS + """, p AS (SELECT a.ring, a.i AS wa, b.i AS wb, round(abs((b.c - a.c) * a.sign - 15e-2) + greatest(0e0, -(least(a.hi, b.hi) - greatest(a.lo, b.lo))), 6) AS score FROM a JOIN a b ON b.ring = a.ring + 1 AND b.axis = a.axis AND b.sign = -a.sign WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= -15e-1 AND (b.c - a.c) * a.sign >= -1e0),
k AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY score, wa, wb) AS n FROM p) SELECT ring, wa, wb, score FROM k WHERE n = 1""")
def j16(spark, d):
    edges = G.axis_edges(base(spark, d, "corners"), ["ring"]).select("ring", "i", "axis", "c", "lo", "hi", "sign")
    links = base(spark, d, "corners").select(F.col("ring").alias("a"), (F.col("ring") + 1).alias("b")).distinct()
    return G.facing_walls(edges, links, "ring").select(F.col("a").alias("ring"), "wa", "wb", F.round("score", 6).alias("score"))


@register("p15_upright", FRM + """, n AS (SELECT frame_id, 2 * (qx * qy + qz * qw) / (qx * qx + qy * qy + qz * qz + qw * qw) AS up FROM frames) SELECT frame_id, round(up, 6) + 0e0 AS up, CAST(CASE WHEN abs(up) < 5e-1 THEN 0 WHEN up > 0 THEN 1 ELSE -1 END AS INTEGER) AS turns, CASE WHEN abs(up) < 5e-1 THEN 128e0 WHEN up > 0 THEN 96e0 ELSE 95e0 END AS cx, CASE WHEN abs(up) < 5e-1 THEN 96e0 WHEN up > 0 THEN 127e0 ELSE 128e0 END AS cy FROM n""")
def p15_up(spark, d):
    """Quarter turns that bring a phone's frames upright, and the principal point after them."""
    up = X.rotation(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])[3]
    turns, _, _, cx, cy = X.upright(up, F.lit(210.0), F.lit(210.0), F.lit(128.0), F.lit(96.0), 256, 192, 0.5)
    return base(spark, d, "frames").select("frame_id", (F.round(up, 6) + 0.0).alias("up"), turns.alias("turns"), cx.alias("cx"), cy.alias("cy"))


@register("p16_letterbox", """ WITH s AS (SELECT p_partkey, p_partkey % 40 AS view_set, 200 + (p_size * 7) % 3 * 50 AS w, 150 + (p_size * 5) % 4 * 30 AS h FROM part), t AS (SELECT view_set, w AS tw, h AS th FROM (SELECT view_set, w, h, row_number() OVER (PARTITION BY view_set ORDER BY count(*) DESC, h DESC, w DESC) AS i FROM s GROUP BY 1, 2, 3) WHERE i = 1),
m AS (SELECT p_partkey, s.view_set, tw, th, least(th / CAST(h AS DOUBLE), tw / CAST(w AS DOUBLE)) AS s, w, h FROM s JOIN t USING (view_set)), k AS (SELECT *, round_even(h * s, 0) AS nh, round_even(w * s, 0) AS nw FROM m)
SELECT p_partkey, CAST(nw AS BIGINT) AS nw, CAST(nh AS BIGINT) AS nh, CAST(floor((tw - nw) / 2) AS BIGINT) AS x0, CAST(floor((th - nh) / 2) AS BIGINT) AS y0, round(w / 2e0 * s + floor((tw - nw) / 2), 6) AS cx, round(200e0 * s, 6) AS fx FROM k""")
def p16(spark, d):
    views = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "p_partkey % 40 as view_set", "200 + (p_size * 7) % 3 * 50 as w", "150 + (p_size * 5) % 4 * 30 as h")
    return rounded(X.letterboxed(views, ["view_set"], F.lit(200.0)).select("p_partkey", "nw", "nh", "x0", "y0", "cx", "fx"), "cx", "fx")


@register("p19_value_half", REG + " SELECT d_ord, concat(printf('%.2f', round(length, 4)), ' ±', printf('%.2f', (round(length + 1645e-3 * (1e-2 + length * 31e-3), 4) - round(length - 1645e-3 * (1e-2 + length * 31e-3), 4)) / 2), ' m') AS label FROM regions")
def p19_half(spark, d):
    m = X.measurement(F.col("length"), 0.01 + F.col("length") * 0.031, "m")
    return base(spark, d, "regions").withColumn("m", m).select("d_ord", X.plus_minus(F.col("m")).alias("label"))


_GRAD = "CASE WHEN {n} IS NULL THEN {c} - {p} WHEN {p} IS NULL THEN {n} - {c} ELSE ({n} - {p}) / 2 END"


def _grad(c: str, w: str) -> str:
    return _GRAD.format(c=c, n=f"lead({c}) OVER {w}", p=f"lag({c}) OVER {w}")


@register("p21_normals", PIX + ", q AS (SELECT frame_id, u, v, (u + 5e-1 - 10e0) * z / 20e0 AS x, (v + 5e-1 - 10e0) * z / 20e0 AS y, z FROM pixels), g AS (SELECT *, " + ", ".join(f"{_grad(c, 'a')} AS g{c}, {_grad(c, 'b')} AS h{c}" for c in "xyz") + """ FROM q WINDOW a AS (PARTITION BY frame_id, v ORDER BY u), b AS (PARTITION BY frame_id, u ORDER BY v)),
n AS (SELECT frame_id, u, v, x, y, z, gy * hz - gz * hy AS nx, gz * hx - gx * hz AS ny, gx * hy - gy * hx AS nz FROM g WHERE gx IS NOT NULL AND hx IS NOT NULL)
SELECT frame_id, u, v, round(ny / (sqrt(nx * nx + ny * ny + nz * nz) + 1e-12) * CASE WHEN -(nx * x + ny * y + nz * z) >= 0 THEN 1 ELSE -1 END, 4) + 0e0 AS ny FROM n""")
def p21(spark, d):
    z = F.col("z")
    rows = base(spark, d, "pixels").select("frame_id", "u", "v", ((F.col("u") + 0.5 - 10.0) * z / 20.0).alias("x"), ((F.col("v") + 0.5 - 10.0) * z / 20.0).alias("y"), "z")
    return G.normals(rows, ["frame_id"]).select("frame_id", "u", "v", (F.round("ny", 4) + 0.0).alias("ny"))


@register("h16_sharpness", PIX + """, l AS (SELECT frame_id, coalesce(lag(z) OVER a, lead(z) OVER a) + coalesce(lead(z) OVER a, lag(z) OVER a) + coalesce(lag(z) OVER b, lead(z) OVER b) + coalesce(lead(z) OVER b, lag(z) OVER b) - 4e0 * z AS lap FROM pixels WINDOW a AS (PARTITION BY frame_id, v ORDER BY u), b AS (PARTITION BY frame_id, u ORDER BY v)) SELECT frame_id, round(var_pop(lap), 6) AS sharpness FROM l GROUP BY 1""")
def h16(spark, d):
    a, b = Window.partitionBy("frame_id", "v").orderBy("u"), Window.partitionBy("frame_id", "u").orderBy("v")
    beside = lambda w: F.coalesce(F.lag("z").over(w), F.lead("z").over(w)) + F.coalesce(F.lead("z").over(w), F.lag("z").over(w))
    return base(spark, d, "pixels").withColumn("lap", beside(a) + beside(b) - 4.0 * F.col("z")).groupBy("frame_id").agg(F.round(F.var_pop("lap"), 6).alias("sharpness"))


@register("h3_resized", PIX + """, t AS (SELECT frame_id, x, y, least(greatest((x + 5e-1) * 20e0 / 13e0 - 5e-1, 0e0), 19e0) AS sx, least(greatest((y + 5e-1) * 20e0 / 9e0 - 5e-1, 0e0), 19e0) AS sy FROM (SELECT DISTINCT frame_id FROM pixels), (SELECT unnest(range(0, 13)) AS x), (SELECT unnest(range(0, 9)) AS y)), o AS (SELECT unnest([0, 1]) AS a), c AS (SELECT frame_id, x, y, CAST(least(floor(sx) + o.a, 19) AS BIGINT) AS u, CAST(least(floor(sy) + p.a, 19) AS BIGINT) AS v, CASE WHEN o.a = 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END * CASE WHEN p.a = 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END AS w FROM t, o, o p)
SELECT c.frame_id, x, y, round(sum(w * z), 6) AS z FROM c JOIN pixels q ON q.frame_id = c.frame_id AND q.u = c.u AND q.v = c.v GROUP BY 1, 2, 3""")
def h3(spark, d):
    return rounded(G.resized(base(spark, d, "pixels"), ["frame_id"], (20, 20), (13, 9)), "z")


@register("h21_nearest", PIX + """ SELECT t.frame_id, x, y, q.z FROM (SELECT frame_id, x, y, CAST(floor(x * 20e0 / 13e0) AS BIGINT) AS u, CAST(floor(y * 20e0 / 9e0) AS BIGINT) AS v FROM (SELECT DISTINCT frame_id FROM pixels), (SELECT unnest(range(0, 13)) AS x), (SELECT unnest(range(0, 9)) AS y)) t JOIN pixels q ON q.frame_id = t.frame_id AND q.u = t.u AND q.v = t.v""")
def h21(spark, d):
    return G.nearest_resized(base(spark, d, "pixels"), ["frame_id"], (20, 20), (13, 9))
