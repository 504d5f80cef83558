"""Rotations, similarities, chains and pose errors.

Sums of products stay in aggregates; only the nearest rotation of a key's 3x3 moments is taken in Arrow batches, a row a
key. A rotation is nine columns, row by row. Keys without enough shared views or pixels give no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planspark.operators.runs import brackets


def _nine(name: str) -> list[Column]:
    return [F.col(f"{name}{i}") for i in range(9)]


def times(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Entries of the product of two 3x3 matrices."""
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def turned(a: Sequence[Column]) -> list[Column]:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def applied(a: Sequence[Column], p: Sequence[Column]) -> list[Column]:
    return [a[3 * i] * p[0] + a[3 * i + 1] * p[1] + a[3 * i + 2] * p[2] for i in range(3)]


def nearest_rotation(rows: DataFrame) -> DataFrame:
    """Rows with m0..m8 and the rotation r0..r8 nearest to them, and ``stretch``, the sum of its signed singular values."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in (*[f"r{i}" for i in range(9)], "stretch")]])
    at = [rows.columns.index(f"m{i}") for i in range(9)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], 1).astype(float).reshape(-1, 3, 3)
                u, s, vt = np.linalg.svd(m)
                sign = np.ones((len(m), 3))
                sign[:, 2] = np.linalg.det(u @ vt)
                r = ((u * sign[:, None, :]) @ vt).reshape(-1, 9)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(r[:, i]) for i in range(9)], pa.array((s * sign).sum(1))], schema=pa.schema([*batch.schema, *[pa.field(f.name, pa.float64()) for f in schema.fields[-10:]]]))

    return rows.mapInArrow(run, schema)


def depth_scale(pixels: DataFrame, keys: Sequence[str], least: int = 100) -> DataFrame:
    """(s, n): median ratio of two depths (before, after) of shared pixels, where enough are valid."""
    ok = pixels.where("before > 0 and after > 0 and before < 'Infinity' and after < 'Infinity'")
    return ok.groupBy(*keys).agg(F.median(F.col("before") / F.col("after")).alias("s"), F.count("*").alias("n")).where(F.col("n") >= least)


def _spread(name: str) -> Column:
    parts = [F.sum(F.col(f"{name}{c}") * F.col(f"{name}{c}")) - F.sum(f"{name}{c}") * F.sum(f"{name}{c}") / F.count("*") for c in "xyz"]
    return parts[0] + parts[1] + parts[2]


def shared_views(views: DataFrame, keys: Sequence[str], scales: DataFrame | None = None, with_scale: bool = True) -> DataFrame:
    """(s, r0..r8, tx, ty, tz) that take poses b into the frame of poses a, from views with a pose in both.

    A view has rotations a0..a8, b0..b8 and centres ax..az, bx..bz. The scale is that of ``scales`` (s), or else of the
    spreads of the centres, or one.
    """
    moments = times(_nine("a"), turned(_nine("b")))
    means = [F.avg(f"{p}{c}").alias(f"{p}{c}") for p in "ab" for c in "xyz"]
    s = F.sqrt(_spread("a") / F.greatest(_spread("b"), F.lit(1e-12))) if with_scale else F.lit(1.0)
    rows = nearest_rotation(views.groupBy(*keys).agg(*[F.sum(m).alias(f"m{i}") for i, m in enumerate(moments)], *means, s.alias("s"), F.count("*").alias("views")))
    if scales is not None:
        rows = rows.drop("s").join(scales.select(*keys, "s"), list(keys))
    moved = applied(_nine("r"), [F.col(f"b{c}") for c in "xyz"])
    return rows.select(*keys, "s", *_nine("r"), *[(F.col(f"a{c}") - F.col("s") * m).alias(f"t{c}") for c, m in zip("xyz", moved, strict=True)])


def fitted_points(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(s, r0..r8, tx, ty, tz): the least-squares similarity that takes points b (bx..bz) to points a (ax..az)."""
    n = F.count("*")
    m = [((F.sum(F.col(f"a{i}") * F.col(f"b{j}")) - F.sum(f"a{i}") * F.sum(f"b{j}") / n) / n).alias(f"m{3 * k + q}") for k, i in enumerate("xyz") for q, j in enumerate("xyz")]
    rows = nearest_rotation(pairs.groupBy(*keys).agg(*m, *[F.avg(f"{p}{c}").alias(f"{p}{c}") for p in "ab" for c in "xyz"], (_spread("b") / n).alias("var")))
    rows = rows.withColumn("s", F.col("stretch") / F.col("var"))
    moved = applied(_nine("r"), [F.col(f"b{c}") for c in "xyz"])
    return rows.select(*keys, "s", *_nine("r"), *[(F.col(f"a{c}") - F.col("s") * m).alias(f"t{c}") for c, m in zip("xyz", moved, strict=True)])


def placed(poses: DataFrame, keys: Sequence[str], moves: DataFrame) -> DataFrame:
    """Poses (p0..p8, x, y, z) moved by their key's similarity."""
    rows = poses.join(moves, list(keys))
    turned_ = times(_nine("r"), _nine("p"))
    at = applied(_nine("r"), [F.col(c) for c in "xyz"])
    new = {f"p{i}": e for i, e in enumerate(turned_)} | {c: F.col("s") * e + F.col(f"t{c}") for c, e in zip("xyz", at, strict=True)}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in poses.columns])


def chained(steps: DataFrame, keys: Sequence[str], order: str = "window") -> DataFrame:
    """Each window's similarity into the first one's frame, from those into the window before (s, r0..r8, tx, ty, tz).

    A key's windows are folded in order as one array; there are as many as a capture has windows.
    """
    x = F.struct(F.col(order).alias("w"), "s", F.array(*_nine("r")).alias("r"), F.array("tx", "ty", "tz").alias("t"))
    rows = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(x)).alias("steps"))
    item = "struct<w:bigint,s:double,r:array<double>,t:array<double>>"
    start = F.struct(F.lit(1.0).alias("s"), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("r"), F.array(*[F.lit(0.0)] * 3).alias("t"), F.array().cast(f"array<{item}>").alias("out"))

    def fold(acc: Column, e: Column) -> Column:
        a, b = [F.get(acc["r"], F.lit(i)) for i in range(9)], [F.get(e["r"], F.lit(i)) for i in range(9)]
        t = [F.get(acc["t"], F.lit(i)) + acc["s"] * m for i, m in enumerate(applied(a, [F.get(e["t"], F.lit(i)) for i in range(3)]))]
        s, r = acc["s"] * e["s"], times(a, b)
        own = F.struct(e["w"].cast("long").alias("w"), s.alias("s"), F.array(*r).alias("r"), F.array(*t).alias("t"))
        return F.struct(s.alias("s"), F.array(*r).alias("r"), F.array(*t).alias("t"), F.concat(acc["out"], F.array(own)).alias("out"))

    out = rows.select(*keys, F.explode(F.aggregate("steps", start, fold)["out"]).alias("o"))
    return out.select(*keys, F.col("o.w").alias(order), "o.s", *[F.get("o.r", F.lit(i)).alias(f"r{i}") for i in range(9)], *[F.get("o.t", F.lit(i)).alias(f"t{c}") for i, c in enumerate("xyz")])


def angle(r: Sequence[Column]) -> Column:
    """Degrees that a rotation turns by."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0] + r[4] + r[8] - 1) / 2))))


def pair_errors(views: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """(i, j, degrees): how far the relative turns of two views differ between truth (a0..a8) and estimate (b0..b8)."""
    names = [f"{p}{k}" for p in "ab" for k in range(9)]
    left = views.select(*keys, F.col(id_col).alias("i"), *[F.col(n).alias(f"i{n}") for n in names])
    right = views.select(*keys, F.col(id_col).alias("j"), *[F.col(n).alias(f"j{n}") for n in names])
    rel = lambda p: times(turned(_nine(f"i{p}")), _nine(f"j{p}"))
    pairs = left.join(right, list(keys)).where("i < j")
    return pairs.select(*keys, "i", "j", angle(times(turned(rel("a")), rel("b"))).alias("degrees"))


def pose_scores(views: DataFrame, keys: Sequence[str], id_col: str, near: float = 10.0) -> DataFrame:
    """Scores of a set of views: median and mean pair error, views within ``near`` degrees after one turn, and the
    root mean square distance of centres after the best similarity."""
    pairs = pair_errors(views, keys, id_col).groupBy(*keys).agg(F.avg("degrees").alias("rot_mean"), F.median("degrees").alias("rot_median"))
    turn = shared_views(views, keys, with_scale=False).select(*keys, *_nine("r"))
    own = views.join(turn, list(keys)).withColumn("off", angle(times(turned(_nine("a")), times(_nine("r"), _nine("b")))))
    ok = own.groupBy(*keys).agg(F.count_if(F.col("off") < near).alias("views_ok"), F.count("*").alias("views"))
    fit = views.join(fitted_points(views, keys), list(keys))
    moved = applied(_nine("r"), [F.col(f"b{c}") for c in "xyz"])
    gaps = [F.col("s") * m + F.col(f"t{c}") - F.col(f"a{c}") for c, m in zip("xyz", moved, strict=True)]
    ate = fit.groupBy(*keys).agg(F.sqrt(F.avg(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])).alias("ate"), F.first("s").alias("scale"))
    return pairs.join(ok, list(keys)).join(ate, list(keys))


def gap_poses(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rotations (qx..qw) of all times t between known ones by slerp, and the nearest known one outside."""
    out = brackets(rows, keys, "t", F.when(F.col("qw").isNotNull(), F.struct("t", "qx", "qy", "qz", "qw")), "_a", "_b")
    out = out.withColumn("_a", F.coalesce("_a", "_b")).withColumn("_b", F.coalesce("_b", "_a"))
    size = lambda q: F.sqrt(sum((F.col(f"{q}.{c}") * F.col(f"{q}.{c}") for c in ("qx", "qy", "qz", "qw")), F.lit(0.0)))
    dot = sum((F.col(f"_a.{c}") * F.col(f"_b.{c}") for c in ("qx", "qy", "qz", "qw")), F.lit(0.0)) / (size("_a") * size("_b"))
    part = F.coalesce(F.try_divide((F.col("t") - F.col("_a.t")).cast("double"), (F.col("_b.t") - F.col("_a.t")).cast("double")), F.lit(0.0))
    theta = F.acos(F.least(F.abs(F.col("_dot")), F.lit(1.0)))
    near = F.sin("_theta") < 1e-9
    wa = F.when(near, 1 - F.col("_part")).otherwise(F.sin((1 - F.col("_part")) * F.col("_theta")) / F.sin("_theta"))
    wb = F.when(near, F.col("_part")).otherwise(F.sin(F.col("_part") * F.col("_theta")) / F.sin("_theta")) * F.when(F.col("_dot") < 0, -1.0).otherwise(1.0)
    out = out.withColumn("_dot", dot).withColumn("_part", part).withColumn("_theta", theta).withColumn("_wa", wa).withColumn("_wb", wb).withColumn("_na", size("_a")).withColumn("_nb", size("_b"))
    return out.select(*keys, "t", *[(F.col("_wa") * F.col(f"_a.{c}") / F.col("_na") + F.col("_wb") * F.col(f"_b.{c}") / F.col("_nb")).alias(c) for c in ("qx", "qy", "qz", "qw")])


def gravity(points: DataFrame, cameras: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(r0..r8): the turn that brings each key's cloud (x, y, z) upright.

    Down is at first the mean image-down direction (dx, dy, dz) of the cameras (x, y, z); twice it is replaced by the
    normal of the densest layer below them, where that has points enough and agrees within 25 degrees.
    """
    group = list(keys)
    mean = cameras.groupBy(*group).agg(*[F.avg(f"d{c}").alias(f"d{c}") for c in "xyz"])
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    down = mean.select(*group, *[(F.col(f"d{c}") / length).alias(f"d{c}") for c in "xyz"])
    depth = F.col("x") * F.col("dx") + F.col("y") * F.col("dy") + F.col("z") * F.col("dz")
    for _ in range(2):
        eyes = cameras.select(*group, "x", "y", "z").join(down, group).groupBy(*group).agg(F.median(depth).alias("eye"))
        below = points.join(down, group).join(eyes, group).withColumn("h", depth).where("h > eye + 5e-1")
        span = below.groupBy(*group).agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("all")).where("all >= 500 and hi > lo")
        bins = below.join(span, group).withColumn("bin", F.least(F.floor((F.col("h") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 200), F.lit(199)))
        top = bins.groupBy(*group, "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).groupBy(*group).agg(F.max_by(F.struct("bin", "lo", "hi"), F.struct("n", -F.col("bin"))).alias("t"))
        layer = below.join(top, group).where(F.abs(F.col("h") - (F.col("t.lo") + (F.col("t.hi") - F.col("t.lo")) * F.col("t.bin") / 200)) < 0.05)
        n = F.count("*")
        cov = [(F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
        flat = layer.groupBy(*group).agg(*cov, n.alias("n")).where("n >= 300")
        down = down.join(_flattest(flat, group), group, "left")
        agree = F.abs(F.col("dx") * F.col("nx") + F.col("dy") * F.col("ny") + F.col("dz") * F.col("nz"))
        ok = F.col("nx").isNotNull() & (F.degrees(F.acos(F.least(agree, F.lit(1.0)))) <= 25)
        sign = F.signum(F.col("dx") * F.col("nx") + F.col("dy") * F.col("ny") + F.col("dz") * F.col("nz"))
        down = down.select(*group, *[F.when(ok, sign * F.col(f"n{c}")).otherwise(F.col(f"d{c}")).alias(f"d{c}") for c in "xyz"])
    # Rodrigues' turn of up = (a, b, c) to (0, 1, 0); straight down it is a half turn about x
    a, b, c = -F.col("dx"), -F.col("dy"), -F.col("dz")
    k = 1 / (1 + b)
    turn = [1 - a * a * k, -a, -a * c * k, a, b, c, -a * c * k, -c, 1 - c * c * k]
    half = [1, 0, 0, 0, -1, 0, 0, 0, -1]
    return down.select(*group, *[F.when(1 + b < 1e-12, float(h)).otherwise(e).alias(f"r{i}") for i, (e, h) in enumerate(zip(turn, half, strict=True))])


def _flattest(rows: DataFrame, group: list[str]) -> DataFrame:
    """(nx, ny, nz): the direction of least spread of each key's covariance."""
    names = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                xx, xy, xz, yy, yz, zz = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names)
                v = np.linalg.eigh(np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).reshape(-1, 3, 3))[1][:, :, 0]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(g)) for g in group], *[pa.array(v[:, i]) for i in range(3)]], names=[*group, "nx", "ny", "nz"])

    return rows.mapInArrow(run, ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", nx double, ny double, nz double")
