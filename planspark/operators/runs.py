"""Ordered operators: runs, picks, windows over positions, first listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def open_runs(slots: DataFrame, keys: Sequence[str], size: float = 0.05, low: float = 0.4, high: float = 3.0) -> DataFrame:
    """Maximal runs of open slots (slot, open, sill) after closing one-slot holes; kind by sill and width."""
    w = Window.partitionBy(*keys).orderBy("slot")
    both = F.coalesce(F.lag("open").over(w), F.lit(False)) & F.coalesce(F.lead("open").over(w), F.lit(False))
    kept = slots.withColumn("on", F.col("open") | both).where("on")
    grouped = kept.withColumn("run", F.col("slot") - F.row_number().over(w))
    runs = grouped.groupBy(*keys, "run").agg(F.min("slot").alias("first"), F.count("*").alias("slots"), F.min("sill").alias("sill"))
    width = F.col("slots") * size
    kind = F.when(F.coalesce(F.col("sill"), F.lit(0.0)) > 0.5, "window").when(width <= 1.2, "door").otherwise("open_passage")
    out = runs.withColumn("width", width).where((F.col("width") >= low) & (F.col("width") <= high)).withColumn("kind", kind)
    return out.select(*keys, (F.col("first") * size).alias("offset"), "width", F.coalesce("sill", F.lit(0.0)).alias("sill"), "kind")


def even_picks(rows: DataFrame, k: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows at k evenly spaced positions (halves to even); all rows where there are no more than k."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("index", F.row_number().over(w.orderBy(*order)) - 1).withColumn("size", F.count("*").over(w))
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("size") - 1) / float(max(1, k - 1))).cast("int"))
    return numbered.where((F.col("size") <= k) | F.array_contains(spots, F.col("index"))).drop("size")


def index_windows(sizes: DataFrame, size: int, overlap: int, keys: Sequence[str]) -> DataFrame:
    """Overlapping windows [first, last] over n positions (column n); the last one is flush with the end."""
    step = size - overlap
    starts = F.when(F.col("n") <= size, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.col("n") - size, F.lit(step).cast("long")), F.array(F.col("n") - size))))
    out = sizes.select(*keys, "n", F.explode(starts).alias("first"))
    return out.select(*keys, "first", (F.least(F.col("first") + size, F.col("n")) - 1).alias("last"))


def window_overlaps(sizes: DataFrame, size: int, overlap: int, keys: Sequence[str]) -> DataFrame:
    """(first, shared): positions that each window of ``index_windows`` shares with the next one, from their bounds alone."""
    windows = index_windows(sizes.withColumn("_n", F.col("n")), size, overlap, [*keys, "_n"]).where(F.col("first") < F.col("_n") - size)
    after = F.least(F.col("first") + (size - overlap), F.col("_n") - size)
    return windows.select(*keys, "first", (F.col("last") - after + 1).alias("shared"))


def brackets(rows: DataFrame, keys: Sequence[str], at: str, known: Column, before: str, after: str) -> DataFrame:
    """Rows with the last value of ``known`` up to them and the first one from them on, nulls skipped.

    One pass in either order: a frame that runs to its partition's end would be evaluated anew for each row.
    """
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc_nulls_last(at), F.desc_nulls_first(at)))
    return rows.withColumn(before, F.last(known, True).over(up)).withColumn(after, F.last(known, True).over(down))


def listed_once(items: DataFrame, keys: Sequence[str], order: Sequence[str], wide: str = "wide") -> DataFrame:
    """Surface-wide items are kept only where they come first of their key; others always stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).where(~F.col(wide) | (F.col("_n") == 1)).drop("_n")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keyframe_shares(pieces: DataFrame, total: int, least: int = 3) -> DataFrame:
    """Keyframes of each piece (length) in proportion, at least ``least``."""
    return pieces.withColumn("keyframes", F.greatest(F.lit(least), F.bround(total * F.col("length") / pieces.agg(F.sum("length")).scalar()).cast("int")))


def prune_contained(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces [first, last] that reach beyond all earlier ones, the longest of equal starts first."""
    w = Window.partitionBy(*keys).orderBy("first", F.desc("last"), "piece").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("_end", F.max("last").over(w)).where(F.col("_end").isNull() | (F.col("last") > F.col("_end"))).drop("_end")


def laid_out(rooms: DataFrame, keys: Sequence[str], order: Sequence[str], gap: float) -> DataFrame:
    """Left edge of rooms (width) set side by side."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rooms.withColumn("left", F.coalesce(F.sum(F.col("width") + gap).over(w), F.lit(0.0)))
