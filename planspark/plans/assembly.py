"""Rules, layouts, graphs, configuration and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.operators import graph, rules
from planspark.operators import runs as R
from planspark.plans.bases import base, cte
from planspark.plans.registry import register

REG, FRM, BOX = (cte(n) for n in ("regions", "frames", "boxes"))


def _text(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _values(rows, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + f") t({names}))"


_FLAGS = _values([(i, *r) for i, r in enumerate(rules.CONCEALED)], "rule_ord, rule_id, r_class, r_surface, below, above, least")
_ITEMS = _values([(i, j, rid, c, s, b, code, q, m, q in rules.WIDE) for i, (rid, c, s, b, items) in enumerate(rules.SCOPE) for j, (code, q, m) in enumerate(items)], "rule_ord, item_ord, rule_id, r_class, r_surface, below, code, qty, margin, wide")
_FIT = "(r_class IS NULL OR r_class = class) AND (r_surface IS NULL OR r_surface = surface) AND (below IS NULL OR coalesce(bottom, 0) < below)"


@register("e1_concealed_flags", REG + f" SELECT room_id, concat('F', CAST(row_number() OVER (PARTITION BY room_id ORDER BY d_ord, rule_ord) AS VARCHAR)) AS flag_id, rule_id, d_ord, surface_id FROM regions JOIN {_FLAGS} r ON {_FIT} AND (above IS NULL OR coalesce(bottom, 0) > above) AND (least IS NULL OR length >= least)")
def e1(spark, d):
    return rules.concealed_flags(base(spark, d, "regions"), ["room_id"])


@register("e2_scope_items", REG + f""", q AS (SELECT *, CASE qty WHEN 'region_area_m2' THEN area WHEN 'region_length_m' THEN length WHEN 'wall_length_m' THEN wall_length WHEN 'wall_area_m2' THEN wall_length * coalesce(ceiling, 25e-1) WHEN 'flood_cut_area_m2' THEN wall_length * 6e-1 ELSE floor_area END * (1e0 + CAST(margin AS DOUBLE)) AS q FROM regions JOIN {_ITEMS} r ON {_FIT}),
k AS (SELECT *, row_number() OVER (PARTITION BY room_id, code, surface_id ORDER BY d_ord, rule_ord, item_ord) AS nth FROM q WHERE q IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY d_ord, rule_ord, item_ord) AS i FROM k WHERE NOT wide OR nth = 1)
SELECT room_id, concat('S', CAST(i AS VARCHAR)) AS item_id, surface_id, code, rule_id, d_ord, CAST(v AS DOUBLE) AS value, round(CAST(v AS DOUBLE) - 1645e-3 * abs(q) * 5e-2, 4) + 0e0 AS lo, round(CAST(v AS DOUBLE) + 1645e-3 * abs(q) * 5e-2, 4) AS hi FROM (SELECT *, round(CAST(q AS DECIMAL(18, 9)), 3) AS v FROM n)""")
def e2(spark, d):
    return rules.scope_items(base(spark, d, "regions"), ["room_id"])


@register("e9_layout", REG + """ SELECT room_id, d_ord, round(coalesce(sum(area + 5e-1) OVER (PARTITION BY room_id ORDER BY d_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 4) AS "left" FROM regions""")
def e9(spark, d):
    rows = base(spark, d, "regions").select("room_id", "d_ord", F.col("area").alias("width"))
    return R.laid_out(rows, ["room_id"], ["d_ord"], 0.5).select("room_id", "d_ord", F.round("left", 4).alias("left"))


@register("e11_audit", REG + """, a AS (SELECT d_ord, unnest([CASE WHEN bottom IS NULL THEN 'no height' END, CASE WHEN ceiling IS NULL THEN 'no ceiling' END, CASE WHEN area < 1e-1 THEN 'tiny' END]) AS warning FROM regions) SELECT d_ord, warning FROM a WHERE warning IS NOT NULL""")
def e11(spark, d):
    checks = F.array(F.when(F.col("bottom").isNull(), "no height"), F.when(F.col("ceiling").isNull(), "no ceiling"), F.when(F.col("area") < 0.1, "tiny"))
    return base(spark, d, "regions").select("d_ord", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("warning"))


@register("w12_listed_once", REG + """, k AS (SELECT *, d_ord % 2 = 0 AS wide, row_number() OVER (PARTITION BY room_id, class, surface_id ORDER BY d_ord) AS nth FROM regions) SELECT room_id, d_ord, class, surface_id FROM k WHERE NOT wide OR nth = 1""")
def w12(spark, d):
    rows = base(spark, d, "regions").select("room_id", "d_ord", "class", "surface_id", (F.col("d_ord") % 2 == 0).alias("wide"))
    return R.listed_once(rows, ["room_id", "class", "surface_id"], ["d_ord"]).drop("wide")


@register("c1_config_layers", """ WITH l AS (SELECT c_custkey % 50 AS key, c_custkey AS layer, c_mktsegment AS value FROM customer) SELECT key, arg_max(value, layer) AS value, max(layer) AS layer FROM l WHERE key < 45 GROUP BY 1""")
def c1(spark, d):
    from planspark.plans.config import effective

    layers = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 50).alias("key"), F.col("c_custkey").alias("layer"), F.col("c_mktsegment").alias("value"))
    return effective(layers, spark.range(45).select(F.col("id").alias("key")))


@register("c3_profile", """ SELECT c_custkey, CASE WHEN c_custkey % 30 >= 22 THEN 'cuda-24gb' WHEN c_custkey % 30 >= 11 THEN 'cuda-16gb' WHEN c_nationkey % 2 = 0 AND c_acctbal / 100 >= 30 THEN 'mac-32gb' WHEN c_nationkey % 2 = 0 AND c_acctbal / 100 >= 15 THEN 'mac-16gb' ELSE 'lite' END AS profile FROM customer""")
def c3(spark, d):
    from planspark.plans.config import profile

    rows = spark.read.parquet(f"{d}/customer.parquet")
    return rows.select("c_custkey", profile(F.col("c_custkey") % 30, F.col("c_nationkey") % 2 == 0, F.col("c_acctbal") / 100).alias("profile"))


_STEPS = ", e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l)"


@register("r2_components", FRM.replace("WITH", "WITH RECURSIVE", 1) + """, l AS (SELECT DISTINCT frame_id AS a, CAST(floor(frame_id / 16) * 16 + (frame_id * 7 + 3) % 16 AS BIGINT) AS b FROM frames)""" + _STEPS + """,
r AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1""")
def r2(spark, d):
    links = base(spark, d, "frames").selectExpr("frame_id as a", "cast(floor(frame_id / 16) * 16 + (frame_id * 7 + 3) % 16 as bigint) as b").distinct()
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return graph.components(nodes, links)


@register("r15_tree", FRM.replace("WITH", "WITH RECURSIVE", 1) + """, l AS (SELECT a, b FROM (SELECT DISTINCT frame_id AS a, CAST(floor(frame_id / 60) * 60 + (frame_id * 7 + 1) % 60 AS BIGINT) AS b FROM frames) WHERE a <> b)""" + _STEPS + """,
r AS (SELECT DISTINCT u AS node, 0 AS depth FROM e WHERE u % 60 = 0 UNION SELECT e.v, r.depth + 1 FROM r JOIN e ON e.u = r.node WHERE r.depth < 60), d AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1)
SELECT d.node, CAST(d.depth AS INTEGER) AS depth, min(p.node) AS parent FROM d LEFT JOIN e ON e.v = d.node LEFT JOIN d p ON p.node = e.u AND p.depth = d.depth - 1 GROUP BY 1, 2""")
def r15(spark, d):
    links = base(spark, d, "frames").selectExpr("frame_id as a", "cast(floor(frame_id / 60) * 60 + (frame_id * 7 + 1) % 60 as bigint) as b").where("a <> b").distinct()
    roots = links.select(F.col("a").alias("node")).union(links.select("b")).where("node % 60 = 0").distinct()
    return graph.tree(links, roots)


def _greedy(keys: str, on: str, limit: str) -> str:
    """Boxes in rank order against the list of those that stand."""
    inter = "greatest(0e0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0e0, least(k.y1, o.y1) - greatest(k.y0, o.y0))"
    area = "(k.x1 - k.x0) * (k.y1 - k.y0) + (o.x1 - o.x0) * (o.y1 - o.y0)"
    met = f"list_filter(r.kept, lambda k: {inter} >= {limit} * ({area} - {inter}) AND {area} - {inter} > 0)"
    pack = "struct_pack(i := o.i, x0 := o.x0, y0 := o.y0, x1 := o.x1, y1 := o.y1)"
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, box_id, x0, y0, x1, y1) AS i FROM boxes),
r AS (SELECT {keys}, i, i AS owner, [{pack.replace("o.", "")}] AS kept FROM o WHERE i = 1 UNION ALL SELECT {", ".join("o." + k.strip() for k in keys.split(","))}, o.i, CASE WHEN len({met}) > 0 THEN {met}[1].i ELSE o.i END, CASE WHEN len({met}) > 0 THEN r.kept ELSE list_append(r.kept, {pack}) END FROM r JOIN o ON {on} AND o.i = r.i + 1)"""


@register("r19_non_maximum", BOX.replace("WITH", "WITH RECURSIVE", 1) + _greedy("image", "o.image = r.image", "4e-1") + " SELECT o.image, o.box_id, o.x0, o.y0, o.x1, o.y1, o.score FROM o JOIN r ON o.image = r.image AND o.i = r.i WHERE r.owner = r.i")
def r19(spark, d):
    return graph.non_maximum(base(spark, d, "boxes").select("image", "box_id", "x0", "y0", "x1", "y1", "score"), ["image"])


@register("r20_merged_views", BOX.replace("WITH", "WITH RECURSIVE", 1) + _greedy("image, class", "o.image = r.image AND o.class = r.class", "2e-1") + """, m AS (SELECT o.*, r.owner FROM o JOIN r ON o.image = r.image AND o.class = r.class AND o.i = r.i), g AS (SELECT image, class, owner, list_sort(list_distinct(list(CAST(box_id AS VARCHAR)))) AS evidence FROM m GROUP BY 1, 2, 3)
SELECT m.image, m.class, m.box_id, m.x0, m.score, array_to_string(g.evidence, ',') AS evidence FROM m JOIN g ON g.image = m.image AND g.class = m.class AND g.owner = m.i WHERE m.owner = m.i""")
def r20(spark, d):
    rows = base(spark, d, "boxes").withColumn("evidence", F.array(F.col("box_id").cast("string"))).select("image", "class", "box_id", "x0", "y0", "x1", "y1", "score", "evidence")
    return graph.merge_views(rows, ["image", "class"]).select("image", "class", "box_id", "x0", "score", F.array_join("evidence", ",").alias("evidence"))
