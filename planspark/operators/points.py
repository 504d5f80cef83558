"""Point clouds: voxels, rasters, coverage, carving, histograms and levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planspark.functions.scalars import cell, median_sigma


def voxel_fuse(points: DataFrame, size: float, support: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Mean point of every voxel with enough points; partial sums are merged by the planner's own two-step aggregate."""
    out = points.groupBy(*keys, cell(F.col("x"), size).alias("kx"), cell(F.col("y"), size).alias("ky"), cell(F.col("z"), size).alias("kz"))
    out = out.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))
    return out.where(F.col("n") >= support) if support > 1 else out


def raster(points: DataFrame, res: float, keys: Sequence[str] = (), u: str = "x", v: str = "z") -> DataFrame:
    return points.groupBy(*keys, cell(F.col(u), res).alias("col"), cell(F.col(v), res).alias("row")).agg(F.count("*").alias("n"))


def vertical_coverage(points: DataFrame, res: float, low: float, high: float, band: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """Share of height bands with a point, by plan cell; both bounds are strict."""
    bands = round((high - low) / band)
    inside = points.where((F.col("y") > low) & (F.col("y") < high))
    own = F.floor((F.col("y") - low) / band)
    return inside.groupBy(*keys, cell(F.col("x"), res).alias("col"), cell(F.col("z"), res).alias("row")).agg((F.countDistinct(own) / F.lit(float(bands))).alias("coverage"))


def carve(rays: DataFrame, res: float, stop: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Rays that cross each cell: one sample every ``res`` from (x0, z0) to (x1, z1), ending ``stop`` before the end."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0"))
    steps = F.floor((F.col("_length") - stop) / res).cast("int")
    walked = rays.withColumn("_length", length).where(F.col("_length") > stop + res).withColumn("_step", F.explode(F.sequence(F.lit(0), steps)))
    share = F.col("_step") * res / F.col("_length")
    at = walked.select(*keys, cell(F.col("x0") + (F.col("x1") - F.col("x0")) * share, res).alias("col"), cell(F.col("z0") + (F.col("z1") - F.col("z0")) * share, res).alias("row"))
    return at.groupBy(*keys, "col", "row").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, cell(F.col(value), width).alias("bin")).agg(F.count("*").alias("n"))


def fullest_bin(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The bin of the highest count, the lowest of equals."""
    return bins.groupBy(*keys).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"))


def dense(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every bin between the first and the last one, zero where there was none."""
    ends = bins.groupBy(*keys).agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    every = ends.select(*keys, F.explode(F.sequence("a", "b")).alias("bin"))
    return every.join(bins, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box_sum(bins: DataFrame, half: int, keys: Sequence[str] = ()) -> DataFrame:
    """Sum over ``half`` bins to either side; expects dense bins."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-half, half)
    return bins.select(*keys, "bin", "n", F.sum("n").over(w).alias("s"))


def floor_level(points: DataFrame, camera_y: float, keys: Sequence[str], support: float = 0.4, width: float = 0.01) -> DataFrame:
    """The lowest flat level below the camera whose smoothed count reaches a share of the densest one."""
    bins = box_sum(dense(histogram(points, "y", width, keys), keys), 2, keys)
    around = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-5, 5)
    every = Window.partitionBy(*keys)
    centre = (F.col("bin") + 0.5) * width
    ranked = bins.withColumn("peak", F.max("s").over(around)).withColumn("below", centre < camera_y - 0.6)
    ranked = ranked.where("below").withColumn("most", F.max("s").over(every))
    strong = (F.col("s") >= support * F.col("most")) & (F.col("s") >= F.col("peak"))
    return ranked.groupBy(*keys).agg(F.coalesce(F.min(F.when(strong, F.col("bin"))), F.max_by("bin", F.struct("n", -F.col("bin")))).alias("bin"))


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], keys: Sequence[str], bins: int = 4096) -> DataFrame:
    """Exact quantiles of each key, interpolated between neighbours, without holding a key's values in one task.

    A histogram says which bins the wanted ranks fall in; only the different values of those bins are put in order. Null
    values do not count, and keys without others have no row.
    """
    group = list(keys)
    own = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    ends = own.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    share = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    binned = own.join(ends, group).withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    histogram = binned.groupBy(*group, "_bin").agg(F.count("*").alias("_c")).withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    rank = lambda p: F.lit(p) * (F.col("_n") - 1)
    asked = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("end"), (F.floor(rank(p)) if k == 0 else F.ceil(rank(p))).alias("rank"), (rank(p) - F.floor(rank(p))).alias("part")) for n, p in shares.items() for k in (0, 1)])
    ranks = ends.select(*group, F.explode(asked).alias("a")).select(*group, "a.*")
    at = ranks.join(histogram, group).where((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_c"))).drop("_c")
    values = binned.join(at.select(*group, "_bin").distinct(), [*group, "_bin"], "left_semi").groupBy(*group, "_bin", "_v").agg(F.count("*").alias("_c"))
    within = Window.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_before", F.coalesce(F.sum("_c").over(within), F.lit(0)))
    hit = at.join(values, [*group, "_bin"]).where((F.col("rank") - F.col("_first") >= F.col("_before")) & (F.col("rank") - F.col("_first") < F.col("_before") + F.col("_c")))
    pick = lambda n, k: F.max(F.when((F.col("name") == n) & (F.col("end") == k), F.col("_v")))
    part = lambda n: F.max(F.when(F.col("name") == n, F.col("part")))
    return hit.groupBy(*group).agg(*[(pick(n, 0) + (pick(n, 1) - pick(n, 0)) * part(n)).alias(n) for n in shares])


def refined_level(points: DataFrame, guesses: DataFrame, keys: Sequence[str], wide: float = 0.04, narrow: float = 0.02) -> DataFrame:
    """Median within ``wide`` of a guess (column guess), then median, spread and count within ``narrow`` of that."""
    near = points.join(guesses, list(keys))
    first = quantiles(near.where(F.abs(F.col("y") - F.col("guess")) < wide), "y", {"level": 0.5}, keys)
    close = points.join(first, list(keys)).where(F.abs(F.col("y") - F.col("level")) < narrow).drop("level")
    out = quantiles(close, "y", {"level": 0.5}, keys).join(close.groupBy(*keys).agg(F.stddev_pop("y").alias("spread"), F.count("*").alias("n")), list(keys))
    return out.withColumn("sigma", median_sigma(F.col("spread"), F.col("n")))


def strided(rows: DataFrame, stride: int, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Every ``stride``-th row of a key by position, the last one left out."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("index", F.row_number().over(w.orderBy(*order)) - 1).withColumn("size", F.count("*").over(w))
    return numbered.where((F.col("index") % stride == 0) & (F.col("index") < F.col("size") - 1)).drop("size")


def sampled(frames: DataFrame, fps: float, keys: Sequence[str], at: str = "ts", order: str = "frame_id") -> DataFrame:
    """The first frame of each of a film's intervals of a length of 1/fps; intervals without a frame give none."""
    pick = F.min_by(F.struct(*frames.columns), F.struct(at, order))
    return frames.groupBy(*keys, F.floor(F.col(at) * fps).alias("sample")).agg(pick.alias("f")).select("sample", "f.*")


def capped(rows: DataFrame, k: int, keys: Sequence[str], ids: Sequence[str], seed: int = 0) -> DataFrame:
    """At most ``k`` rows of a key, picked by a seeded hash of their ids."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids])), *ids)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def fragments(frames: DataFrame, size: int, keys: Sequence[str] = (), index: str = "index") -> DataFrame:
    """Fragment number by position; a short tail joins the fragment before it."""
    whole = F.greatest(F.floor((F.max(index).over(Window.partitionBy(*keys)) + 1) / size), F.lit(1))
    return frames.withColumn("fragment", F.least(F.floor(F.col(index) / size), whole - 1).cast("long"))


def percentile_filter(rows: DataFrame, value: str, share: float) -> DataFrame:
    """Rows at or above a global percentile."""
    return rows.where(F.col(value) >= rows.agg(F.percentile(value, F.lit(share))).scalar())


def valid_pixel(conf: Column, depth: Column, least_conf: int, far: float, near: float = 0.1) -> Column:
    """Confident enough and strictly between the depth bounds."""
    return (conf >= least_conf) & (depth > near) & (depth < far)
