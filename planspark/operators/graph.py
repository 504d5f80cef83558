"""Components, trees and greedy labelling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planspark.operators.storage import written


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component. Labels spread to neighbours and then jump to their own label's label."""
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = nodes.select("node", F.col("node").alias("root"))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("heard"))
        spread = labels.join(heard.withColumnRenamed("u", "node"), "node", "left").select("node", "root", F.least("root", F.coalesce("heard", "root")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = written(spread.join(jump, "low", "left").select("node", "root", F.least("low", F.coalesce("far", "low")).alias("next")))
        if not new.where("next <> root").head(1):
            return new.select("node", "root")
        labels = new.select("node", F.col("next").alias("root"))


def tree(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, parent, depth) of a breadth-first tree over links (a, b) from roots (node); the smallest parent wins."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    seen = roots.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"))
    front, depth = seen, 0
    while front.head(1):
        depth += 1
        step = both.join(front.select(F.col("node").alias("u")), "u").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        front = written(step.join(seen, "node", "left_anti").select("node", "parent", F.lit(depth).alias("depth")))
        seen = seen.unionByName(front)
    return seen


def _overlapping(boxes: np.ndarray, limit: float) -> list[int]:
    """For each box (x0, y0, x1, y1) the boxes it shares ``limit`` of the union with, as the bits of a number."""
    size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    out: list[int] = []
    for at in range(0, len(boxes), 512):
        part = boxes[at : at + 512, None]
        both = np.clip(np.minimum(part[..., 2:], boxes[None, :, 2:]) - np.maximum(part[..., :2], boxes[None, :, :2]), 0, None).prod(2)
        union = size[at : at + 512, None] + size[None, :] - both
        hit = np.divide(both, union, out=np.zeros_like(both), where=union > 0) >= limit
        out += [int.from_bytes(row.tobytes(), "little") for row in np.packbits(hit, axis=1, bitorder="little")]
    return out


def _owners(boxes: np.ndarray, limit: float) -> list[int]:
    """In the order given: the first box that stands and overlaps, or else the box itself, which then stands."""
    standing, owners = 0, []
    for i, hits in enumerate(_overlapping(boxes, limit)):
        met = hits & standing
        owners.append((met & -met).bit_length() - 1 if met else i)
        standing |= 0 if met else 1 << i
    return owners


def labelled(boxes: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """Boxes with their ``rank`` in the group (best score first, then id and corners) and the rank of their ``owner``."""
    corners = ["x0", "y0", "x1", "y1"]
    names, n = boxes.columns, len(keys)
    schema = T.StructType([*boxes.schema.fields, T.StructField("rank", T.LongType()), T.StructField("owner", T.LongType())])

    def finish(group: pa.Table) -> Iterator[pa.RecordBatch]:
        owners = _owners(np.stack([group.column(names.index(c)).to_numpy() for c in corners], 1).astype(float), limit)
        yield from group.append_column("rank", pa.array(range(len(owners)), pa.int64())).append_column("owner", pa.array(owners, pa.int64())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = 0
            own = list(zip(*[batch.column(names.index(k)).to_pylist() for k in keys], strict=True)) if n else [()] * batch.num_rows
            for i, key in enumerate(own):
                if key != last:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    if held:
                        yield from finish(pa.Table.from_batches(held))
                    held, at, last = [], i, key
            if batch.num_rows > at:
                held.append(batch.slice(at))
        if held:
            yield from finish(pa.Table.from_batches(held))

    ordered = boxes.repartition(*keys).sortWithinPartitions(*keys, F.desc("score"), "box_id", *corners)
    return ordered.mapInArrow(run, schema)


def non_maximum(boxes: DataFrame, keys: Sequence[str], limit: float = 0.4) -> DataFrame:
    """Boxes that overlap no better one that stands by ``limit`` or more; a group is the boxes of one image."""
    return labelled(boxes, keys, limit).where(F.col("rank") == F.col("owner")).drop("rank", "owner")


def merge_views(regions: DataFrame, keys: Sequence[str], limit: float = 0.2) -> DataFrame:
    """One region for each that stands, with the evidence of all regions it owns, sorted and once each."""
    own = F.col("rank") == F.col("owner")
    rest = [c for c in regions.columns if c not in keys and c != "evidence"]
    found = labelled(regions, keys, limit).groupBy(*keys, "owner").agg(*[F.max(F.when(own, F.col(c))).alias(c) for c in rest], F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return found.select(*regions.columns)


def path_sums(nodes: DataFrame, value: str) -> DataFrame:
    """(node, value summed up to the root) of a forest (node, parent, value); a parent that is no node is none.

    Each round doubles the distance that a node looks up, so the rounds are the logarithm of the depth.
    """
    named = nodes.select("node")
    at = written(nodes.join(named.select(F.col("node").alias("parent"), F.lit(True).alias("_known")), "parent", "left").select("node", F.when(F.col("_known"), F.col("parent")).alias("up"), F.col(value).alias("sum")))
    while at.where("up is not null").head(1):
        above = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("sum").alias("more"))
        at = written(at.join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum")))
    return at.select("node", F.col("sum").alias(value))


def spread_views(views: DataFrame, room: str, id_col: str, k: int) -> DataFrame:
    """(room, i, id): ``k`` views (yaw, x, z, sharp) of each room, the sharpest first, then always the one whose nearest
    picked view is farthest in direction and place; earlier in sharpness wins ties. A room has some dozens of views."""
    kinds = dict(views.dtypes)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["sharp", id_col], ascending=[False, True])
        yaw, x, z = (pdf[c].to_numpy(float) for c in ("yaw", "x", "z"))
        picks, gap = [0], np.full(len(pdf), np.inf)
        while True:
            p = picks[-1]
            turn = np.abs(np.arctan2(np.sin(yaw - yaw[p]), np.cos(yaw - yaw[p])))
            gap = np.minimum(gap, np.round(turn / np.pi + 0.25 * np.sqrt((x - x[p]) ** 2 + (z - z[p]) ** 2), 9))
            if len(picks) == min(k, len(pdf)):
                break
            picks.append(int(gap.argmax()))
        return pd.DataFrame({room: pdf[room].iloc[0], "i": range(1, len(picks) + 1), id_col: pdf[id_col].to_numpy()[picks]})

    return views.groupBy(room).applyInPandas(run, f"`{room}` {kinds[room]}, i long, `{id_col}` {kinds[id_col]}")
