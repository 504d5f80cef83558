"""Polygons, walls, segments and cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(corners: DataFrame, keys: Sequence[str], order: str = "i") -> DataFrame:
    """Corners (u, v) to edges with the next corner (u2, v2); the last one closes the ring."""
    w = Window.partitionBy(*keys).orderBy(order)
    ring = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return corners.withColumn("u2", F.coalesce(F.lead("u").over(w), F.first("u").over(ring))).withColumn("v2", F.coalesce(F.lead("v").over(w), F.first("v").over(ring)))


def signed_area(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shoelace area and perimeter of rings of edges."""
    return rings.groupBy(*keys).agg((F.sum(F.col("u") * F.col("v2") - F.col("v") * F.col("u2")) / 2).alias("area"), F.sum(F.hypot(F.col("u2") - F.col("u"), F.col("v2") - F.col("v"))).alias("perimeter"))


def box_sides(corners: DataFrame, keys: Sequence[str]) -> DataFrame:
    du, dv = F.max("u") - F.min("u"), F.max("v") - F.min("v")
    return corners.groupBy(*keys).agg(F.least(du, dv).alias("short"), F.greatest(du, dv).alias("long"))


def inside_polygon(points: DataFrame, rings: DataFrame, keys: Sequence[str], point_keys: Sequence[str]) -> DataFrame:
    """Points (pu, pv) in their ring by the parity of edge crossings; edges are few a key, so each point meets only its own."""
    crosses = ((F.col("v") > F.col("pv")) != (F.col("v2") > F.col("pv"))) & (F.col("pu") < (F.col("u2") - F.col("u")) * F.try_divide(F.col("pv") - F.col("v"), F.col("v2") - F.col("v")) + F.col("u"))
    met = points.join(rings, list(keys)).groupBy(*keys, *point_keys).agg(F.count_if(crosses).alias("crossings"))
    return met.where(F.col("crossings") % 2 == 1).drop("crossings")


def crossing(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Parameters of the crossing of a ray a-b with a wall c-d, null if they are parallel."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    s = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), den)
    t = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), den)
    return s, t


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), length), F.lit(0.0))))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def overlap_ratio(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.coalesce(F.try_divide(w * h, union), F.lit(0.0))


def square(half: int) -> list[tuple[int, int]]:
    """Steps of a square kernel."""
    return [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1)]


def ellipse(half: int) -> list[tuple[int, int]]:
    """Steps of a round kernel: each row as wide as the circle there, halves to even."""
    return [(a, b) for b in range(-half, half + 1) for a in range(-half, half + 1) if abs(a) <= round(half * (1 - (b / half) ** 2) ** 0.5)]


def _spread(cells: DataFrame, steps: Sequence[tuple[int, int]], keys: Sequence[str]) -> DataFrame:
    kernel = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    return cells.select(*keys, "col", "row").distinct().select(*keys, "col", "row", F.explode(kernel).alias("s")).select(*keys, (F.col("col") + F.col("s.a")).alias("col"), (F.col("row") + F.col("s.b")).alias("row"))


def dilate(cells: DataFrame, steps: Sequence[tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    """Cells that a step of the (symmetric) kernel leads to from any cell."""
    return _spread(cells, steps, keys).distinct()


def erode(cells: DataFrame, steps: Sequence[tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    """Cells all of whose kernel is set; outside the cells nothing is."""
    return _spread(cells, steps, keys).groupBy(*keys, "col", "row").agg(F.count("*").alias("n")).where(F.col("n") == len(steps)).drop("n")


def close(cells: DataFrame, steps: Sequence[tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    return erode(dilate(cells, steps, keys), steps, keys)


def open_(cells: DataFrame, steps: Sequence[tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    return dilate(erode(cells, steps, keys), steps, keys)


def touching(cells: DataFrame, keys: Sequence[str], corners: bool) -> DataFrame:
    """(node, root): the components of cells that touch by sides, or by corners too; a node is (keys, col, row)."""
    from planspark.operators.graph import components

    node = cells.select(*keys, "col", "row").distinct()
    steps = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if corners else [])]
    spread = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    place = F.struct(*keys, "col", "row")
    beside = node.select(*keys, "col", "row", spread.alias("_s"), place.alias("_b")).select(*keys, (F.col("col") - F.col("_s.a")).alias("col"), (F.col("row") - F.col("_s.b")).alias("row"), "_b")
    links = node.join(beside, [*keys, "col", "row"]).select(place.alias("_a"), "_b").toDF("a", "b")
    return components(node.select(place.alias("node")), links)


def flooded(free: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Free cells that a flood from the seeds reaches over their sides."""
    parts = touching(free, keys, corners=False)
    wet = parts.join(seeds.select(F.struct(*keys, "col", "row").alias("node")), "node", "left_semi").select("root").distinct()
    return parts.join(wet, "root", "left_semi").select("node.*")


def hull(cells: DataFrame, key: str) -> DataFrame:
    """(key, col, row, side): the corners of the convex hull of a key's cells, along its lower and its upper side.

    Tasks get the lowest and the highest cell of each column, so a chain is as long as the plan is wide.
    """
    ends = cells.groupBy(key, "col").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    kind = dict(cells.dtypes)[key]

    def run(pdf):
        import pandas as pd

        pdf, rows = pdf.sort_values("col"), []
        for side, column, sign in (("lower", "lo", 1), ("upper", "hi", -1)):
            chain: list[tuple[int, int]] = []
            for c, r in zip(pdf["col"].tolist(), pdf[column].tolist(), strict=True):
                while len(chain) > 1 and sign * ((chain[-1][0] - chain[-2][0]) * (r - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (c - chain[-2][0])) <= 0:
                    chain.pop()
                chain.append((c, r))
            rows += [(pdf[key].iloc[0], c, r, side) for c, r in chain]
        return pd.DataFrame(rows, columns=[key, "col", "row", "side"])

    return ends.groupBy(key).applyInPandas(run, f"`{key}` {kind}, col long, row long, side string")


def hull_cells(cells: DataFrame, key: str) -> DataFrame:
    """All cells whose centres lie in the convex hull of a key's cells, its border included."""
    w = Window.partitionBy(key, "side").orderBy("col")
    sides = hull(cells, key).withColumns({"c2": F.lead("col").over(w), "r2": F.lead("row").over(w)})
    every = sides.withColumn("at", F.explode(F.sequence("col", F.coalesce("c2", "col"))))
    height = F.col("row") + F.coalesce((F.col("r2") - F.col("row")) * F.try_divide(F.col("at") - F.col("col"), F.col("c2") - F.col("col")), F.lit(0.0))
    span = every.groupBy(key, "at").agg(F.ceil(F.round(F.min(F.when(F.col("side") == "lower", height)), 9)).alias("lo"), F.floor(F.round(F.max(F.when(F.col("side") == "upper", height)), 9)).alias("hi"))
    return span.where("lo <= hi").select(key, F.col("at").alias("col"), F.explode(F.sequence("lo", "hi")).alias("row"))


def enclosed(band: DataFrame, walls: DataFrame, seeds: DataFrame, key: str, gap: int) -> DataFrame:
    """Interior cells: a flood from the seeds inside the hull of all band cells, walls thickened by ``gap`` cells.

    The thickening closes small holes in walls; it is given back to the interior afterwards.
    """
    inside, kernel = hull_cells(band, key), ellipse(gap)
    place = [key, "col", "row"]
    free = inside.join(dilate(walls, kernel, [key]), place, "left_anti")
    wet = dilate(flooded(free, seeds.join(free, place, "left_semi"), [key]), kernel, [key])
    return wet.join(inside, place, "left_semi").join(walls.select(*place).distinct(), place, "left_anti")


def axis_edges(polygons: DataFrame, keys: Sequence[str], shortest: float = 0.3) -> DataFrame:
    """Edges (i, axis, c, lo, hi, sign) of rings of corners; the sign points out of the room."""
    rows = edges(polygons, keys).join(polygons.groupBy(*keys).agg(F.avg("u").alias("mu"), F.avg("v").alias("mv")), list(keys))
    du, dv = F.abs(F.col("u2") - F.col("u")), F.abs(F.col("v2") - F.col("v"))
    flat = du < dv
    pick = lambda a, b: F.when(flat, a).otherwise(b)
    out = rows.where(F.hypot(du, dv) >= shortest).select(*keys, "i", "u", "v", pick(F.lit(0), F.lit(1)).alias("axis"), pick((F.col("u") + F.col("u2")) / 2, (F.col("v") + F.col("v2")) / 2).alias("c"), pick(F.least("v", "v2"), F.least("u", "u2")).alias("lo"), pick(F.greatest("v", "v2"), F.greatest("u", "u2")).alias("hi"), pick(F.col("mu"), F.col("mv")).alias("_m"))
    return out.withColumn("sign", F.when(F.col("c") > F.col("_m"), 1).otherwise(-1)).drop("_m")


def facing_walls(edges_: DataFrame, links: DataFrame, key: str, thickness: float = 0.15, doors: DataFrame | None = None) -> DataFrame:
    """The best pair of facing walls (a, b, wa, wb, gap, door, score) of every two linked rooms (a, b).

    Walls run parallel with their outsides to each other. A pair scores by how far its gap is from a wall's thickness and
    how far it misses along the wall; doors (key, i, at) that line up within 2.5 m take one off.
    """
    a = edges_.select(F.col(key).alias("a"), F.col("i").alias("wa"), "axis", F.col("c").alias("ca"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.col("sign").alias("sa"))
    b = edges_.select(F.col(key).alias("b"), F.col("i").alias("wb"), "axis", F.col("c").alias("cb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), (-F.col("sign")).alias("sa"))
    pairs = links.join(a, "a").join(b, ["b", "axis", "sa"]).withColumn("gap", (F.col("cb") - F.col("ca")) * F.col("sa")).withColumn("shared", F.least("ha", "hb") - F.greatest("la", "lb"))
    pairs = pairs.where("shared >= -15e-1 and gap >= -1e0")
    if doors is None:
        pairs = pairs.withColumn("door", F.lit(None).cast("double"))
    else:
        da, db = (doors.select(F.col(key).alias(r), F.col("i").alias(f"w{r}"), F.col("at").alias(f"d{r}")) for r in "ab")
        lined = pairs.select("a", "b", "wa", "wb").join(da, ["a", "wa"]).join(db, ["b", "wb"]).withColumn("off", F.col("da") - F.col("db"))
        best = lined.groupBy("a", "b", "wa", "wb").agg(F.min_by("off", F.struct(F.abs("off"), "da", "db")).alias("door"))
        pairs = pairs.join(best.where(F.abs("door") < 2.5), ["a", "b", "wa", "wb"], "left")
    score = F.abs(F.col("gap") - thickness) + F.greatest(F.lit(0.0), -F.col("shared")) - F.when(F.col("door").isNotNull(), 1.0).otherwise(0.0)
    ranked = pairs.withColumn("score", score).withColumn("_n", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.round("score", 6), "wa", "wb")))
    return ranked.where("_n = 1").select("a", "b", "wa", "wb", "axis", F.col("sa").alias("sign"), "gap", "door", "score")


def normals(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit normals (nx, ny, nz) of pixels (u, v, x, y, z) seen from the origin, by differences along rows and columns."""
    across, down = Window.partitionBy(*keys, "v").orderBy("u"), Window.partitionBy(*keys, "u").orderBy("v")

    def slope(c: str, w) -> Column:
        after, before = F.lead(c).over(w), F.lag(c).over(w)
        return F.when(after.isNull(), F.col(c) - before).when(before.isNull(), after - F.col(c)).otherwise((after - before) / 2)

    rows = pixels.withColumns({f"a{c}": slope(c, across) for c in "xyz"} | {f"b{c}": slope(c, down) for c in "xyz"}).where("ax is not null and bx is not null")
    n = [F.col("ay") * F.col("bz") - F.col("az") * F.col("by"), F.col("az") * F.col("bx") - F.col("ax") * F.col("bz"), F.col("ax") * F.col("by") - F.col("ay") * F.col("bx")]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) + 1e-12
    facing = F.when(-(n[0] * F.col("x") + n[1] * F.col("y") + n[2] * F.col("z")) >= 0, 1).otherwise(-1)
    return rows.select(*keys, "u", "v", *[(e / size * facing).alias(name) for e, name in zip(n, ("nx", "ny", "nz"), strict=True)])


def _targets(pixels: DataFrame, keys: Sequence[str], size: tuple[int, int]) -> DataFrame:
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return pixels.select(*keys).distinct().withColumn("x", span(size[0])).withColumn("y", span(size[1]))


def resized(pixels: DataFrame, keys: Sequence[str], source: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Rasters (u, v, z) at another size (x, y, z), bilinear between pixel centres."""
    at = lambda c, k: F.least(F.greatest((F.col(c) + 0.5) * float(source[k]) / float(size[k]) - 0.5, F.lit(0.0)), F.lit(float(source[k] - 1)))
    rows = _targets(pixels, keys, size).withColumn("sx", at("x", 0)).withColumn("sy", at("y", 1))
    near = lambda c, k, o: F.least(F.floor(c) + o, F.lit(source[k] - 1)).cast("long")
    part = lambda c, o: (F.col(c) - F.floor(c)) if o else 1 - (F.col(c) - F.floor(c))
    four = F.array(*[F.struct(near("sx", 0, a).alias("u"), near("sy", 1, b).alias("v"), (part("sx", a) * part("sy", b)).alias("w")) for a in (0, 1) for b in (0, 1)])
    asked = rows.select(*keys, "x", "y", F.explode(four).alias("n")).select(*keys, "x", "y", "n.*")
    return asked.join(pixels, [*keys, "u", "v"]).groupBy(*keys, "x", "y").agg(F.sum(F.col("w") * F.col("z")).alias("z"))


def nearest_resized(pixels: DataFrame, keys: Sequence[str], source: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Rasters at another size by the pixel at the floor of the scaled place, as masks are resized."""
    at = lambda c, k: F.floor(F.col(c) * float(source[k]) / float(size[k])).cast("long")
    rows = _targets(pixels, keys, size).withColumn("u", at("x", 0)).withColumn("v", at("y", 1))
    return rows.join(pixels, [*keys, "u", "v"]).select(*keys, "x", "y", "z")


def on_walls(openings: DataFrame, walls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Openings (offset, width) with their ends (u0, v0, u1, v1) along their wall's edge; nulls where there is no wall."""
    rows = openings.join(walls.select(*keys, "u", "v", "u2", "v2"), list(keys), "left")
    length = F.greatest(F.hypot(F.col("u2") - F.col("u"), F.col("v2") - F.col("v")), F.lit(1e-9))
    at = lambda c, c2, far: F.col(c) + (F.col(c2) - F.col(c)) / length * far
    far = F.col("offset") + F.col("width")
    return rows.withColumns({"u0": at("u", "u2", F.col("offset")), "v0": at("v", "v2", F.col("offset")), "u1": at("u", "u2", far), "v1": at("v", "v2", far)}).drop("u", "v", "u2", "v2")


def corrected(rows: DataFrame, moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Places (x, z) turned by ``a`` about (cx, cz) and shifted by (tx, tz) of their fragment."""
    at = rows.join(moves, list(keys))
    dx, dz, c, s = F.col("x") - F.col("cx"), F.col("z") - F.col("cz"), F.cos("a"), F.sin("a")
    new = {"x": c * dx - s * dz + F.col("cx") + F.col("tx"), "z": s * dx + c * dz + F.col("cz") + F.col("tz")}
    return at.select(*[new[n].alias(n) if n in new else F.col(n) for n in rows.columns])


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Common area of two simple polygons (n, 2), exact but for rounding.

    Between neighbouring abscissae of corners and crossings no two edges cross, so the common length at the middle of a
    slab, times its width, is the slab's common area.
    """

    def edges_of(p: np.ndarray) -> np.ndarray:
        e = np.concatenate([p, np.roll(p, -1, 0)], 1)
        return e[e[:, 0] != e[:, 2]]

    ea, eb = edges_of(a), edges_of(b)
    d, e = ea[:, None, 2:] - ea[:, None, :2], eb[None, :, 2:] - eb[None, :, :2]
    gap = eb[None, :, :2] - ea[:, None, :2]
    den = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * e[..., 1] - gap[..., 1] * e[..., 0]) / den
    crossing_ = (ea[:, None, 0] + t * d[..., 0])[np.isfinite(t) & (t > 0) & (t < 1)]
    xs = np.unique(np.concatenate([a[:, 0], b[:, 0], crossing_]))
    total = 0.0
    for x0, x1 in zip(xs[:-1].tolist(), xs[1:].tolist(), strict=True):
        m, heights = (x0 + x1) / 2, []
        for own in (ea, eb):
            there = own[(np.minimum(own[:, 0], own[:, 2]) < m) & (m < np.maximum(own[:, 0], own[:, 2]))]
            heights.append(np.sort(there[:, 1] + (m - there[:, 0]) * (there[:, 3] - there[:, 1]) / (there[:, 2] - there[:, 0])).reshape(-1, 2))
        low, high = np.maximum(heights[0][:, None, 0], heights[1][None, :, 0]), np.minimum(heights[0][:, None, 1], heights[1][None, :, 1])
        total += float(np.clip(high - low, 0, None).sum()) * (x1 - x0)
    return total


def _box(polygon: str) -> list[Column]:
    """Least and greatest abscissa and ordinate of a nested polygon."""
    at = lambda i: F.transform(polygon, lambda p: F.get(p, F.lit(i)))
    return [pick(at(i)) for pick in (F.array_min, F.array_max) for i in (0, 1)]


def polygon_overlaps(rooms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(a, b, share) of every two rooms (id, polygon) of a plan: common area over the smaller one's area.

    Only rooms whose boxes meet are laid over each other.
    """
    named = rooms.select(*keys, "id", "polygon", *[c.alias(n) for c, n in zip(_box("polygon"), ("x0", "y0", "x1", "y1"), strict=True)])
    side = lambda s: named.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("id", "polygon", "x0", "y0", "x1", "y1")])
    meet = (F.col("p_x0") < F.col("q_x1")) & (F.col("q_x0") < F.col("p_x1")) & (F.col("p_y0") < F.col("q_y1")) & (F.col("q_y0") < F.col("p_y1"))
    pairs = side("p").join(side("q"), list(keys)).where("p_id < q_id").withColumn("meet", meet)
    out = [*keys, F.col("p_id").alias("a"), F.col("q_id").alias("b")]
    near = pairs.where("meet").select(*out, "p_polygon", "q_polygon")
    names = [*keys, "a", "b"]
    schema = ", ".join(f"`{c}` {k}" for c, k in near.select(*names).dtypes) + ", share double"

    def area(p: np.ndarray) -> float:
        return abs(float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)))) / 2

    def run(batches):
        for batch in batches:
            shares = []
            for p, q in zip(batch.column("p_polygon").to_pylist(), batch.column("q_polygon").to_pylist(), strict=True):
                p, q = np.array(p, float), np.array(q, float)
                small = min(area(p), area(q))
                shares.append(overlap_area(p, q) / small if small > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(shares, pa.float64())], names=[*names, "share"])

    return near.mapInArrow(run, schema).unionByName(pairs.where("not meet").select(*out, F.lit(0.0).alias("share")))
