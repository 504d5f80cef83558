"""Rooms out of plan cells: interior maps, splitting at doors, outlines, and which rooms meet.

Cells are (key, col, row) of a grid of ``res`` metres. What joins and counts express stays in DataFrames; splitting and
tracing walk over one capture's grid, which is as large as its floor, in one task a capture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.functions.scalars import cell
from planspark.operators import geometry as G
from planspark.operators import points as P


def maps(points: DataFrame, rays: DataFrame, cameras: DataFrame, key: str, res: float = 0.02, carve: bool = True) -> dict[str, DataFrame]:
    """Cells of ``walls``, ``floor`` and ``interior`` of points (x, y above the floor, z) in the wall-aligned plan.

    Walls are tall and continuous, the floor is flat; the interior is what three rays (x0, z0, x1, z1) cross, or, without
    ``carve``, what a flood from the cameras (x, z) reaches between the walls; floods under half a square metre fall back
    to the rays.
    """
    place = [key, "col", "row"]
    walls = G.close(P.vertical_coverage(points, res, 0.2, 1.8, 0.1, [key]).where("coverage >= 35e-2"), G.square(1), [key])
    floor = G.close(P.raster(points.where(F.abs("y") < 0.04), res, [key]), G.square(4), [key])
    crossed = P.carve(rays, res, 0.05, [key]).where("n >= 3").select(*place).join(walls, place, "left_anti")
    free = crossed
    if not carve:
        band = P.raster(points.where("y > 2e-1 and y < 18e-1"), res, [key])
        seeds = cameras.select(key, cell(F.col("x"), res).alias("col"), cell(F.col("z"), res).alias("row"))
        wet = G.enclosed(band, walls, seeds, key, max(1, int(0.3 / res)))
        enough = wet.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * res * res >= 0.5).select(key)
        free = wet.join(enough, key, "left_semi").unionByName(crossed.join(enough, key, "left_anti"))
    interior = G.open_(G.close(free, G.square(2), [key]), G.square(2), [key])
    return {"walls": walls, "floor": floor, "interior": interior}


def _grid(pdf: pd.DataFrame, pad: int) -> tuple[np.ndarray, int, int]:
    col, row = pdf["col"].to_numpy(), pdf["row"].to_numpy()
    c0, r0 = int(col.min()) - pad, int(row.min()) - pad
    out = np.zeros((int(row.max()) - r0 + pad + 1, int(col.max()) - c0 + pad + 1), bool)
    out[row - r0, col - c0] = True
    return out, c0, r0


def core(mask: np.ndarray, radius: float) -> np.ndarray:
    """Cells farther than ``radius`` cells from every cell that is not set."""
    out = mask.copy()
    reach = int(radius)
    holes = np.pad(~mask, ((reach, reach), (reach + 1, reach)), constant_values=True)
    holes[:, 0] = False
    run = holes.cumsum(1)
    for dy in range(-reach, reach + 1):
        half = int((radius * radius - dy * dy) ** 0.5)
        rows = run[reach + dy : reach + dy + mask.shape[0]]
        out &= rows[:, reach + half + 1 : reach + half + 1 + mask.shape[1]] == rows[:, reach - half : reach - half + mask.shape[1]]
    return out


def labels(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Numbers 1, 2, ... of the components of set cells, in reading order; runs of a row are joined to those above."""
    out = np.zeros(mask.shape, np.int64)
    root: list[int] = [0]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, line in enumerate(mask):
        step = np.diff(np.concatenate([[0], line.view(np.int8), [0]]))
        runs = []
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            own = len(root)
            root.append(own)
            for c, d, other in above:
                if c < b + diagonal and a < d + diagonal:
                    low, high = sorted((find(own), find(other)))
                    root[high] = low
            out[y, a:b] = own
            runs.append((a, b, own))
        above = runs
    names = {r: k + 1 for k, r in enumerate(sorted({find(i) for i in range(1, len(root))}))}
    return np.array([0, *[names[find(i)] for i in range(1, len(root))]])[out]


def grown(seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Seeds spread over the mask, cell by cell over sides, all at once; where two meet the lower number takes the cell."""
    out = np.where(mask, seeds, 0)
    far = np.iinfo(np.int64).max
    while True:
        wide = np.pad(np.where(out > 0, out, far), 1, constant_values=far)
        best = np.minimum.reduce([wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        new = mask & (out == 0) & (best < far)
        if not new.any():
            return out
        out[new] = best[new]


def split(interior: DataFrame, track: DataFrame, key: str, res: float, door: float = 0.38, least_seed: float = 0.15, least: float = 1.0) -> DataFrame:
    """(key, room, col, row): rooms grown from the cores of the interior that are farther than half a door from any wall.

    Small cores are no rooms; rooms that the track (key, col, row) never enters, or under a square metre, are left out.
    Narrow tongues are cut off. A capture without a core has no room.
    """
    kinds = dict(interior.dtypes)
    both = interior.select(key, "col", "row", F.lit(True).alias("inside")).unionByName(track.select(key, "col", "row", F.lit(False).alias("inside")).distinct())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, seen, rows = pdf[pdf["inside"]], pdf[~pdf["inside"]], []
        if len(own):
            mask, c0, r0 = _grid(own, 1)
            seeds = labels(core(mask, door / res), True)
            small = np.flatnonzero(np.bincount(seeds.reshape(-1)) * res * res < least_seed)
            rooms = grown(np.where(np.isin(seeds, small), 0, seeds), mask)
            c, r = seen["col"].to_numpy() - c0, seen["row"].to_numpy() - r0
            ok = (c >= 0) & (c < mask.shape[1]) & (r >= 0) & (r < mask.shape[0])
            for k in sorted(set(rooms[r[ok], c[ok]].tolist()) - {0}):
                room = rooms == k
                if room.sum() * res * res >= least:
                    y, x = np.nonzero(_opened(room, 2))
                    rows.append(pd.DataFrame({key: own[key].iloc[0], "room": len(rows) + 1, "col": x + c0, "row": y + r0}))
        return pd.concat(rows) if rows else pd.DataFrame({key: pdf[key].iloc[:0], "room": [], "col": [], "row": []})

    return both.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, room long, col long, row long")


def _eroded(mask: np.ndarray, half: int) -> np.ndarray:
    for axis in (0, 1):
        wide = np.pad(mask, [(half, half) if a == axis else (0, 0) for a in (0, 1)])
        mask = np.logical_and.reduce([np.take(wide, range(k, k + mask.shape[axis]), axis) for k in range(2 * half + 1)])
    return mask


def _dilated(mask: np.ndarray, half: int) -> np.ndarray:
    return ~_eroded_full(~mask, half)


def _eroded_full(mask: np.ndarray, half: int) -> np.ndarray:
    """Erosion with everything outside set."""
    for axis in (0, 1):
        wide = np.pad(mask, [(half, half) if a == axis else (0, 0) for a in (0, 1)], constant_values=True)
        mask = np.logical_and.reduce([np.take(wide, range(k, k + mask.shape[axis]), axis) for k in range(2 * half + 1)])
    return mask


def _opened(mask: np.ndarray, half: int) -> np.ndarray:
    return _dilated(_eroded(mask, half), half)


def boundary(mask: np.ndarray) -> np.ndarray:
    """Corners (x, y) of the longest outline of set cells, counter-clockwise in a plan whose y grows up.

    The outline runs along the sides of cells, with the cells on its left; only turns are kept.
    """
    m = np.pad(mask, 1)
    follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in zip(*np.nonzero(m), strict=True):
        for there, a, b in ((m[y - 1, x], (x, y), (x + 1, y)), (m[y, x + 1], (x + 1, y), (x + 1, y + 1)), (m[y + 1, x], (x + 1, y + 1), (x, y + 1)), (m[y, x - 1], (x, y + 1), (x, y))):
            if not there:
                follow.setdefault(a, []).append(b)
    best: list[tuple[int, int]] = []
    while follow:
        start = at = next(iter(follow))
        ring, came = [], None
        while True:
            ways = follow[at]
            if came is not None and len(ways) > 1:  # two cells touch at this corner: turn left, so they stay apart
                left = (at[0] - (at[1] - came[1]), at[1] + (at[0] - came[0]))
                nxt = left if left in ways else ways[0]
            else:
                nxt = ways[0]
            ways.remove(nxt)
            if not ways:
                del follow[at]
            ring.append(at)
            came, at = at, nxt
            if at == start:
                break
        best = max(best, ring, key=len)
    ring_ = np.array(best, float) - 1
    turn = np.any(np.roll(ring_, -1, 0) - ring_ != ring_ - np.roll(ring_, 1, 0), axis=1)
    return ring_[turn]


def simplified(ring: np.ndarray, eps: float) -> np.ndarray:
    """A closed ring without the corners that lie within ``eps`` of the rest (farthest corners are kept first)."""
    if len(ring) < 4:
        return ring
    far = int(((ring - ring[0]) ** 2).sum(1).argmax())

    def chain(p: np.ndarray) -> list[int]:
        keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d = p[b] - p[a]
            length = float(np.hypot(*d))
            gap = p[a + 1 : b] - p[a]
            off = np.abs(d[0] * gap[:, 1] - d[1] * gap[:, 0]) / length if length else np.hypot(gap[:, 0], gap[:, 1])
            k = int(off.argmax())
            if off[k] > eps:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return sorted(keep)

    first, second = ring[: far + 1], np.concatenate([ring[far:], ring[:1]])
    return np.concatenate([first[chain(first)][:-1], second[chain(second)][:-1]])


def outlines(rooms: DataFrame, key: str, res: float, eps: float = 0.08, fill: float = 0.4) -> DataFrame:
    """(key, room, i, u, v): simplified outlines of rooms (key, room, col, row); bites up to ``fill`` wide are filled, but
    not into cells within two of another room's."""
    kinds = dict(rooms.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        half = max(3, int(fill / res) | 1) // 2
        whole, c0, r0 = _grid(pdf, half + 3)
        out = []
        for room, own in pdf.groupby("room"):
            mask = np.zeros_like(whole)
            mask[own["row"].to_numpy() - r0, own["col"].to_numpy() - c0] = True
            closed = _eroded(_dilated(mask, half), half) & ~_dilated(whole & ~mask, 2)
            ring = simplified(boundary(closed | mask), eps / res)
            out.append(pd.DataFrame({key: pdf[key].iloc[0], "room": room, "i": range(len(ring)), "u": (ring[:, 0] + c0) * res, "v": (ring[:, 1] + r0) * res}))
        return pd.concat(out)

    return rooms.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, room long, i int, u double, v double")


def passages(rooms: DataFrame, interior: DataFrame, key: str, reach: int = 10) -> DataFrame:
    """(key, a, b): rooms (key, room, col, row) joined by one stretch of interior between them.

    Only interior that no room has, within ``reach`` cells of both, may bridge; cracks of one cell are closed.
    """
    place = [key, "col", "row"]
    loose = interior.select(*place).join(rooms.select(*place), place, "left_anti")
    near = G.dilate(rooms, G.square(reach), [key, "room"])
    touch = near.join(rooms.select(*place, F.col("room").alias("b")), place).where("room < b").select(key, F.col("room").alias("a"), "b").distinct()
    beside = near.join(loose, place)
    bridge = touch.join(beside.withColumnRenamed("room", "a"), [key, "a"]).join(beside.withColumnRenamed("room", "b"), [key, "b", "col", "row"]).select(key, "a", "b", "col", "row")
    own = lambda r: touch.join(rooms.withColumnRenamed("room", r), [key, r]).select(key, "a", "b", "col", "row", F.col(r).alias("room"))
    cells = own("a").unionByName(own("b")).unionByName(bridge.withColumn("room", F.lit(None).cast("long")))
    step = [(0, 0), (0, 1), (1, 0), (1, 1)]
    parts = G.touching(G.dilate(cells.select(key, "a", "b", "col", "row"), step, [key, "a", "b"]), [key, "a", "b"], corners=False)
    node = F.struct(key, "a", "b", "col", "row").alias("node")
    held = cells.where("room is not null").select(node, "room", "a", "b", F.col(key).alias("_k")).join(parts, "node").groupBy("_k", "a", "b", "root").agg(F.countDistinct("room").alias("n"))
    return held.where("n = 2").select(F.col("_k").alias(key), "a", "b").distinct()


def plan_axes(points: DataFrame, angles: DataFrame, key: str, x: str = "x", z: str = "z") -> tuple[DataFrame, Column, Column]:
    """Points with their capture's ``degree``, and their coordinates in the wall-aligned plan."""
    rows = points.join(angles.select(key, "degree"), key)
    a = F.radians("degree")
    return rows, F.cos(a) * F.col(x) + F.sin(a) * F.col(z), F.cos(a) * F.col(z) - F.sin(a) * F.col(x)
