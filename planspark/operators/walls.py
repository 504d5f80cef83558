"""Walls and outlines: the dominant angle, axis-aligned edges, fitted walls, corners, boxes and ceilings.

A point cloud is in plan coordinates (u, v) with heights y above the floor; an edge runs along the other axis than the one
it is fitted on: ``axis`` 0 is a wall at u = c, ``axis`` 1 one at v = c. Null coordinates fall out of every window; a key
without points gives no row unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planspark.functions.scalars import measurement, median_sigma
from planspark.operators.points import fullest_bin

EDGE = "struct<axis:int,c:double,s:double,e:double>"


def angle_scores(points: DataFrame, key: str, steps: Sequence[float], res: float) -> DataFrame:
    """(key, k, score): sharpness of the projections of points (x, z, base) turned back by ``base`` plus each step.

    The score is the sum of squared bin counts over both axes. Tasks pass on histograms, not turned points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            x, z, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for i, name in enumerate(names.dictionary.to_pylist()):
                own = names.indices.to_numpy() == i
                for k, step in enumerate(steps):
                    a = np.radians(at[own] + step)
                    for axis, c in ((0, np.cos(a) * x[own] + np.sin(a) * z[own]), (1, np.cos(a) * z[own] - np.sin(a) * x[own])):
                        bins = np.floor(c / res).astype(np.int64)
                        low = int(bins.min())
                        first, counts = held.get((name, k, axis), (low, np.zeros(0, np.int64)))
                        start, new = min(first, low), np.bincount(bins - low)
                        total = np.zeros(max(first + len(counts), low + len(new)) - start, np.int64)
                        total[first - start : first - start + len(counts)] += counts
                        total[low - start : low - start + len(new)] += new
                        held[name, k, axis] = start, total
        for (name, k, axis), (first, counts) in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), batch.schema.field(0).type), pa.array([k] * len(at), pa.int32()), pa.array([axis] * len(at), pa.int32()), pa.array(first + at), pa.array(counts[at])], names=[key, "k", "axis", "bin", "n"])

    rows = points.where("x is not null and z is not null").select(key, "x", "z", "base")
    bins = rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, k int, axis int, bin long, n long").groupBy(key, "k", "axis", "bin").agg(F.sum("n").alias("n"))
    return bins.groupBy(key, "k").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


def dominant_angle(points: DataFrame, key: str, res: float = 0.02) -> DataFrame:
    """(key, degree): the angle in [0, 90) that makes walls most axis-aligned, by whole degrees, then by twentieths."""

    def best(scores: DataFrame) -> DataFrame:
        return scores.groupBy(key).agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"), F.max("score").alias("score"))

    whole = best(angle_scores(points.withColumn("base", F.lit(0.0)), key, range(90), res)).select(key, F.col("k").cast("double").alias("base"), F.col("score").alias("rough"))
    fine = best(angle_scores(points.join(whole.select(key, "base"), key), key, [-1.0 + k * 0.05 for k in range(40)], res))
    turned = F.col("base") + (-1.0 + F.col("k") * 0.05)
    return whole.join(fine, key).select(key, F.when(F.col("score") > F.col("rough"), turned).otherwise(F.col("base")).alias("degree"))


def _merged(a: Column, b: Column) -> Column:
    return F.struct(a["axis"].alias("axis"), ((a["c"] + b["c"]) / 2).alias("c"), a["s"].alias("s"), b["e"].alias("e"))


def rectilinear(edges: DataFrame, keys: Sequence[str], order: str = "i", shortest: float = 0.3) -> DataFrame:
    """Rings of edges (u, v, u2, v2) as axis-aligned ones (k, axis, c, s, e): short ones go, neighbours of one axis merge.

    Merging averages pairwise in ring order, and the last edge joins the first; a ring is folded as one array.
    """
    du, dv = F.abs(F.col("u2") - F.col("u")), F.abs(F.col("v2") - F.col("v"))
    flat = du < dv
    edge = F.struct(F.when(flat, 0).otherwise(1).alias("axis"), F.when(flat, (F.col("u") + F.col("u2")) / 2).otherwise((F.col("v") + F.col("v2")) / 2).alias("c"), F.when(flat, F.col("v")).otherwise(F.col("u")).alias("s"), F.when(flat, F.col("v2")).otherwise(F.col("u2")).alias("e"))
    rings = edges.where(F.hypot(du, dv) >= shortest).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), edge.alias("x")))), lambda r: r["x"]).alias("_ring"))

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(_merged(last, x)))
        return F.when(last["axis"] == x["axis"], joined).otherwise(F.concat(done, F.array(x)))

    folded = rings.withColumn("_ring", F.aggregate("_ring", F.array().cast(f"array<{EDGE}>"), step))
    first, last = F.get("_ring", F.lit(0)), F.get("_ring", F.size("_ring") - 1)
    closed = F.when((F.size("_ring") > 1) & (first["axis"] == last["axis"]), F.concat(F.array(_merged(last, first)), F.slice("_ring", F.lit(2), F.greatest(F.size("_ring") - 2, F.lit(0))))).otherwise(F.col("_ring"))
    return folded.select(*keys, F.posexplode(closed).alias("k", "x")).select(*keys, "k", "x.*")


def fitted(edges: DataFrame, points: DataFrame, keys: Sequence[str], search: float = 0.25) -> DataFrame:
    """Edges (k, axis, c, s, e, sign) with their fitted ``pos``, ``sigma`` and ``n``: the densest layer of points near them.

    Points count from 15 cm outside to 10 cm inside (``sign`` points into the room) and 10 cm away from the ends; with
    fewer than 50 of them the edge stays where it is with a sigma of 5 cm.
    """
    along, across = F.when(F.col("axis") == 0, F.col("v")).otherwise(F.col("u")), F.when(F.col("axis") == 0, F.col("u")).otherwise(F.col("v"))
    rel = (across - F.col("c")) * F.col("sign")
    near = points.join(edges, list(keys)).where((along > F.least("s", "e") + 0.1) & (along < F.greatest("s", "e") - 0.1) & (rel > -0.15) & (rel < 0.10))
    near = near.select(*keys, "k", "c", across.alias("p"))
    group = [*keys, "k"]
    bins = near.groupBy(*group, F.floor((F.col("p") - (F.col("c") - search)) / 0.01).alias("bin")).agg(F.count("*").alias("n"))
    peak = fullest_bin(bins, group).select(*group, "bin")
    seen = near.groupBy(*group).agg(F.count("*").alias("seen"))
    layer = near.join(peak, group).where(F.abs(F.col("p") - (F.col("c") - search + F.col("bin") * 0.01 + 0.005)) < 0.02)
    fit = layer.groupBy(*group).agg(F.median("p").alias("pos"), F.stddev_pop("p").alias("spread"), F.count("*").alias("n"))
    enough = F.col("seen") >= 50
    out = edges.join(seen, group, "left").join(fit, group, "left")
    return out.select(*edges.columns, F.when(enough, F.col("pos")).otherwise(F.col("c")).alias("pos"), F.when(enough, median_sigma(F.col("spread"), F.col("n"))).otherwise(F.lit(0.05)).alias("sigma"), F.when(enough, F.col("n")).otherwise(F.coalesce("seen", F.lit(0))).alias("n"))


def corners(walls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(i, u, v): where each wall (k, axis, pos) meets the next, counter-clockwise; neighbours of one axis meet nowhere."""
    w = Window.partitionBy(*keys).orderBy("k")
    ring = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, here = F.struct("axis", "pos"), F.col("axis") == 0
    met = walls.withColumn("nx", F.coalesce(F.lead(own).over(w), F.first(own).over(ring))).where("axis <> nx.axis")
    met = met.select(*keys, F.row_number().over(w).alias("i"), F.when(here, F.col("pos")).otherwise(F.col("nx.pos")).alias("u"), F.when(here, F.col("nx.pos")).otherwise(F.col("pos")).alias("v"))
    w = Window.partitionBy(*keys).orderBy("i")
    ring = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    u2, v2 = F.coalesce(F.lead("u").over(w), F.first("u").over(ring)), F.coalesce(F.lead("v").over(w), F.first("v").over(ring))
    turned = met.withColumn("cross", F.col("u") * v2 - F.col("v") * u2).withColumn("area", F.sum("cross").over(Window.partitionBy(*keys))).withColumn("size", F.count("*").over(Window.partitionBy(*keys)))
    back = (F.col("area") < 0) & (F.col("size") >= 3)
    return turned.select(*keys, F.when(back, F.col("size") - F.col("i")).otherwise(F.col("i") - 1).cast("int").alias("i"), "u", "v")


def outermost(points: DataFrame, centres: DataFrame, keys: Sequence[str], size: float = 0.02, cover: float = 0.25, span: float = 0.4, least: int = 30) -> DataFrame:
    """(axis, lo, hi): a room's box between the outermost slices that are tall and long enough to be walls.

    ``points`` (u, v, h) lie in the band 0.2 to 1.8 m, ``centres`` hold (cu, cv) of the cameras. A slice is three bins
    wide; rooms with fewer than 200 points, or without a wall on a side, have no row for the axis.
    """
    group = list(keys)
    lo, hi = (lambda c, q: F.percentile(c, F.lit(q))), 0.98
    extent = points.groupBy(*group).agg(F.count("*").alias("all"), *[(lo(c, hi) - lo(c, 0.02)).alias(f"l{c}") for c in "uv"], F.min("u").alias("minu"), F.min("v").alias("minv")).where("all >= 200")
    sides = F.array(F.struct(F.lit(0).alias("axis"), F.col("u").alias("p"), F.col("v").alias("q"), F.greatest("lv", F.lit(0.5)).alias("length"), F.col("minu").alias("low")), F.struct(F.lit(1).alias("axis"), F.col("v").alias("p"), F.col("u").alias("q"), F.greatest("lu", F.lit(0.5)).alias("length"), F.col("minv").alias("low")))
    rows = points.join(extent, group).select(*group, "h", F.explode(sides).alias("x")).select(*group, "h", "x.*")
    own = F.floor((F.col("p") - (F.col("low") - size)) / size)
    spread = rows.withColumn("bin", F.explode(F.array(own - 1, own, own + 1)))
    there = rows.select(*group, "axis", own.alias("bin")).distinct()
    band = F.least(F.greatest(F.floor((F.col("h") - 0.2) / 0.1), F.lit(0)), F.lit(15))
    slices = spread.join(there, [*group, "axis", "bin"], "left_semi").groupBy(*group, "axis", "bin").agg(F.count("*").alias("n"), F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), band.cast("int")))).alias("bands"), F.countDistinct(F.floor(F.col("q") / 0.1)).alias("tenths"), F.first("length").alias("length"), F.median("p").alias("at"))
    walls = slices.where((F.col("n") >= least) & (F.col("bands") / 16 >= cover) & (F.col("tenths") * 0.1 >= span * F.col("length")))
    centre = F.when(F.col("axis") == 0, F.col("cu")).otherwise(F.col("cv"))
    picked = walls.join(centres, group).groupBy(*group, "axis").agg(F.min(F.when(F.col("at") < centre, F.col("at"))).alias("lo"), F.max(F.when(F.col("at") > centre, F.col("at"))).alias("hi"))
    return picked.where("lo is not null and hi is not null")


def ceilings(points: DataFrame, rooms: DataFrame, keys: Sequence[str], voxel: float) -> DataFrame:
    """(level, sigma, second) of rooms (area) from heights h above the floor: null where too little was seen.

    The ceiling is the densest level from 1.9 to 4 m, with 200 points and a layer over 40 % of the area; a second level, 15 cm
    away at least, must cover 25 %.
    """
    group = list(keys)

    def level(rows: DataFrame, res: float, half: float, share: float, name: str) -> DataFrame:
        total = rows.groupBy(*group).agg(F.count("*").alias("all")).where("all >= 200")
        top = fullest_bin(rows.groupBy(*group, F.floor((F.col("h") - 1.9) / res).alias("bin")).agg(F.count("*").alias("n")), group).select(*group, "bin")
        layer = rows.join(total, group).join(top, group).where(F.abs(F.col("h") - (1.9 + F.col("bin") * res + res / 2)) < half)
        found = layer.groupBy(*group).agg(F.median("h").alias(name), F.stddev_pop("h").alias("spread"), F.count("*").alias("n"))
        return found.join(rooms, group).where(F.col("n") * voxel * voxel >= share * F.col("area")).select(*group, name, median_sigma(F.col("spread"), F.col("n")).alias("sigma"))

    up = points.where("h > 19e-1 and h < 4e0")
    first = level(up, 0.01, 0.02, 0.4, "level")
    other = level(up.join(first.select(*group, "level"), group).where(F.abs(F.col("h") - F.col("level")) > 0.15).drop("level"), 0.05, 0.03, 0.25, "second")
    return rooms.select(*group).join(first, group, "left").join(other.drop("sigma"), group, "left")


def records(rings: DataFrame, keys: Sequence[str], absolute: float, relative: float) -> DataFrame:
    """Room records of rings (i, u, v, sigma of wall i): walls with lengths, perimeter and floor area with their intervals.

    A corner is where two walls meet, so a wall's length depends on the walls before and after it; the area's variance is
    that of the walls and of the common scale.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    ring = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def ahead(c: str, k: int) -> Column:
        return F.get(F.collect_list(c).over(ring), (F.row_number().over(w) - 1 + k) % F.count("*").over(Window.partitionBy(*keys)))

    walls = rings.withColumns({"u2": ahead("u", 1), "v2": ahead("v", 1), "after": ahead("sigma", 2)})
    length, noise = F.hypot(F.col("u2") - F.col("u"), F.col("v2") - F.col("v")), F.col("sigma") * F.col("sigma") + F.col("after") * F.col("after") + 2 * absolute * absolute
    walls = walls.withColumn("length", length).withColumn("noise", noise).withColumn("var", F.col("noise") + (relative * F.col("length")) * (relative * F.col("length")))
    each = F.struct("i", F.array("u", "v").alias("start"), F.array("u2", "v2").alias("end"), measurement(F.col("length"), F.sqrt("var"), "m").alias("length"))
    out = walls.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("walls"), F.sum("length").alias("_p"), F.sqrt(F.sum("var")).alias("_ps"), F.sum("noise").alias("_n"), F.abs(F.sum(F.col("u") * F.col("v2") - F.col("v") * F.col("u2")) / 2).alias("_a"))
    sigma = F.hypot(F.sqrt("_n") * F.sqrt("_a") / 2, 2 * relative * F.col("_a"))
    return out.select(*keys, "walls", measurement(F.col("_p"), F.col("_ps"), "m").alias("perimeter"), measurement(F.col("_a"), sigma, "m2").alias("floor_area"))
