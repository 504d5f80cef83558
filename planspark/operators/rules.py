"""Rule tables matched against damage regions: concealed-damage flags and scope line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planspark.functions.scalars import measurement

# The rule tables. Class, surface, bottom below, bottom above, least length; null matches anything.
CONCEALED = [
    ("R-WATER-BASE", "water_stain", "wall", 0.30, None, None),
    ("R-WATER-HIGH", "water_stain", "wall", None, 1.50, None),
    ("R-CEIL-STAIN", "water_stain", "ceiling", None, None, None),
    ("R-MOLD-ANY", "mold", None, None, None, None),
    ("R-CRACK-LONG", "crack", None, None, None, 0.60),
]
SCOPE = [
    ("S-WALL-STAIN", "water_stain", "wall", None, [("DRY-SEAL", "region_area_m2", 0.25), ("PNT-WALL", "wall_area_m2", 0.0)]),
    ("S-WALL-STAIN-BASE", "water_stain", "wall", 0.30, [("DRY-FLOOD", "wall_length_m", 0.0), ("DRY-RPL", "flood_cut_area_m2", 0.0)]),
    ("S-CEIL-STAIN", "water_stain", "ceiling", None, [("DRY-SEAL", "region_area_m2", 0.25), ("PNT-CEIL", "floor_area_m2", 0.0)]),
    ("S-MOLD", "mold", None, None, [("WTR-MOLD", "region_area_m2", 0.5)]),
    ("S-CRACK", "crack", None, None, [("DRY-PATCH", "region_length_m", 0.15), ("PNT-WALL", "wall_area_m2", 0.0)]),
    ("S-HOLE", "hole", None, None, [("DRY-PATCH", "region_area_m2", 0.10), ("PNT-WALL", "wall_area_m2", 0.0)]),
]
WIDE = ("wall_area_m2", "floor_area_m2", "wall_length_m", "flood_cut_area_m2")
DEFAULT_CEILING, FLOOD_CUT, RELATIVE_ERROR = 2.5, 0.6, 0.05


def concealed_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(CONCEALED)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, r_class string, r_surface string, below double, above double, least double")


def scope_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, j, rid, c, s, below, code, qty, margin, qty in WIDE) for i, (rid, c, s, below, items) in enumerate(SCOPE) for j, (code, qty, margin) in enumerate(items)]
    return spark.createDataFrame(rows, "rule_ord int, item_ord int, rule_id string, r_class string, r_surface string, below double, code string, qty string, margin double, wide boolean")


def matches(length: bool) -> Column:
    """All given predicates of a rule hold; a missing height counts as zero."""
    bottom = F.coalesce(F.col("bottom"), F.lit(0.0))
    ok = (F.col("r_class").isNull() | (F.col("r_class") == F.col("class"))) & (F.col("r_surface").isNull() | (F.col("r_surface") == F.col("surface"))) & (F.col("below").isNull() | (bottom < F.col("below")))
    if length:
        ok = ok & (F.col("above").isNull() | (bottom > F.col("above"))) & (F.col("least").isNull() | (F.col("length") >= F.col("least")))
    return ok


def concealed_flags(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Flags of every region and rule that fits, numbered in order of region and rule. The rule table is a constant."""
    hit = regions.join(F.broadcast(concealed_rules(regions.sparkSession)), matches(True))
    w = Window.partitionBy(*keys).orderBy("d_ord", "rule_ord")
    return hit.select(*keys, F.concat(F.lit("F"), F.row_number().over(w)).alias("flag_id"), "rule_id", "d_ord", "surface_id")


def quantities() -> Column:
    """Derived quantities by name; null where the region has no wall."""
    ceiling = F.coalesce(F.col("ceiling"), F.lit(DEFAULT_CEILING))
    values = {"region_area_m2": F.col("area"), "region_length_m": F.col("length"), "wall_length_m": F.col("wall_length"), "wall_area_m2": F.col("wall_length") * ceiling, "flood_cut_area_m2": F.col("wall_length") * FLOOD_CUT, "floor_area_m2": F.col("floor_area")}
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(F.col("qty") == name, value).otherwise(out)
    return out


def scope_items(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Line items of every region and rule that fits; surface-wide items once a surface and code, in arrival order."""
    hit = regions.join(F.broadcast(scope_rules(regions.sparkSession)), matches(False)).withColumn("q", quantities() * (1 + F.col("margin"))).where("q is not null")
    order = ["d_ord", "rule_ord", "item_ord"]
    before = Window.partitionBy(*keys, "code", "surface_id").orderBy(*order)
    kept = hit.withColumn("nth", F.row_number().over(before)).where(~F.col("wide") | (F.col("nth") == 1))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    m = measurement(F.round("q", 3), F.abs("q") * RELATIVE_ERROR, "")
    return kept.select(*keys, F.concat(F.lit("S"), number).alias("item_id"), "surface_id", "code", "rule_id", "d_ord", m["value"].alias("value"), m["lo"].alias("lo"), m["hi"].alias("hi"))
