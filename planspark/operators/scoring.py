"""Scores over plans and ground truth: gates, interval coverage, repeatability, depth errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Gate tolerances by tier.
WALL_TOLERANCE = {"photos": 0.08, "video": 0.03, "lidar": 0.01}
AREA_TOLERANCE = {"photos": 0.10, "video": 0.05, "lidar": 0.02}
CEILING_TOLERANCE, LEAST_WALL_TOLERANCE, OPENING_TOLERANCE, OPENING_SHARE = 0.015, 0.02, 0.02, 0.85


def _by_tier(values: dict[str, float]):
    out = F.lit(None).cast("double")
    for tier, v in values.items():
        out = F.when(F.col("tier") == tier, v).otherwise(out)
    return out


def gates(rows: DataFrame) -> DataFrame:
    """(quantity, tier, predicted, truth) rows with their error, tolerance and verdict; lidar walls also have a floor."""
    wall = _by_tier(WALL_TOLERANCE) * F.col("truth")
    wall = F.when(F.col("tier") == "lidar", F.greatest(F.lit(LEAST_WALL_TOLERANCE), wall)).otherwise(wall)
    tolerance = F.when(F.col("quantity") == "wall", wall).when(F.col("quantity") == "area", _by_tier(AREA_TOLERANCE) * F.col("truth")).otherwise(F.lit(CEILING_TOLERANCE))
    out = rows.withColumn("error", F.col("predicted") - F.col("truth")).withColumn("tolerance", tolerance)
    return out.withColumn("passed", F.abs("error") <= F.col("tolerance"))


def opening_gate(predicted: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(hits, n, passed): truths with a prediction within 2 cm, over the larger number of both; 85 % must be found.

    Openings of a room are few, so its lists are compared in place.
    """
    both = truth.groupBy(*keys).agg(F.collect_list("truth").alias("t")).join(predicted.groupBy(*keys).agg(F.collect_list("predicted").alias("p")), list(keys), "left")
    both = both.withColumn("p", F.coalesce("p", F.array().cast("array<double>")))
    hits = F.size(F.filter("t", lambda t: F.exists("p", lambda p: F.abs(p - t) <= OPENING_TOLERANCE)))
    out = both.select(*keys, hits.cast("long").alias("hits"), F.greatest(F.size("t"), F.size("p")).cast("long").alias("n"))
    return out.withColumn("passed", F.col("hits") >= OPENING_SHARE * F.col("n"))


def coverage(rows: DataFrame) -> DataFrame:
    """Share of intervals [lo, hi] that hold the truth, by quantity and tier, with all subtotals."""
    holds = (F.col("truth") >= F.col("lo")) & (F.col("truth") <= F.col("hi"))
    out = rows.groupingSets([("quantity", "tier"), ("quantity",), ("tier",), ()], "quantity", "tier").agg(F.count_if(holds).alias("held"), F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("held") / F.col("n"), 6))


def repeatability(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, range and sample deviation of repeated runs; null runs do not count."""
    return runs.groupBy(*keys).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"), F.stddev_samp(value).alias("std"))


def depth_errors(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute relative error after the median scale, and that scale."""
    ratio = rows.withColumn("ratio", F.col("truth") / F.col("depth"))
    scale = ratio.groupBy(*keys).agg(F.median("ratio").alias("scale"))
    err = F.abs(F.col("depth") * F.col("scale") - F.col("truth")) / F.col("truth")
    return rows.join(scale, list(keys)).groupBy(*keys).agg(F.first("scale").alias("scale"), F.avg(err).alias("absrel"))


def median_of_medians(rows: DataFrame, keys: Sequence[str], inner: str, value: str) -> DataFrame:
    """Robust scale of a key: the median over inner groups' medians, their spread, and its standard error."""
    each = rows.groupBy(*keys, inner).agg(F.median(value).alias("m"))
    out = each.groupBy(*keys).agg(F.median("m").alias("scale"), F.stddev_pop("m").alias("spread"), F.count("*").alias("n"))
    return out.withColumn("se", 1.25 * F.col("spread") / F.sqrt("n"))
