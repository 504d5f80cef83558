"""SimHash near-duplicates through segment popcounts.

A text's fingerprint takes, bit by bit, the majority of its shingles' 64-bit hashes. Fingerprints are embedded as the
popcounts of their 32 two-bit segments; the Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints, so it is a lower bound that prunes. The range join on the embedding works on a grid: the segments form
eight groups, and two embeddings within distance d agree in at least 8 - d whole groups, so they share the grid cell of
one choice of that many groups (70 choices for distance four). Points are dealt by cell and compared within it, and every
candidate is verified by the exact Hamming distance. Equal fingerprints are one point throughout.

No cell is ever multiplied: a cell with more than ``BLOCK`` points is first dealt twice at random into blocks of bounded
size, which links nearly all that can be linked; only what its points still leave in different components is compared
again, the largest component's blocks against the rest. Of the links of a run a spanning forest is passed on, never all
pairs. Components come from alternating large-star and small-star rounds, each written to the shared folder.

``keep_first`` takes the same steps for the similarity of whole sets of shingles, over several fingerprints: popcounts of
two-bit segments, a grid of segments' counts, the Manhattan bound, the Hamming distance, and the exact sets at the end (see
``similar_links``).

Edge cases: a null, empty or blank text has fingerprint zero (an empty set) and is linked like any other. Fewer words
than a shingle: the whole sequence is one shingle. Ids may be of any type that has an order. Rows that repeat an id and a
text count as one document; rows that share an id alone stay documents of their own. A null id joins its component's
smallest other id, and ``keep_first`` keeps such rows. Very long texts are hashed whole. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, release

MAX_BITS = 4
SEED = 42
#: Points of a block: what is compared with each other at a time.
BLOCK = 2048
_GROUPS = 8
_LOW = 0x5555555555555555
#: Rows of an Arrow batch of points, which are a few numbers each.
NARROW = 1 << 14
#: Points of a run up to which all runs of a batch are compared together.
_RUN = 24


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 hashes of all shingles; A-Z lower-cased, words parted by ASCII white space."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], "<u8")


def remixed(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Independent hashes (seed, shingle) out of one; seed zero keeps it."""
    z = hashes[None, :] ^ seeds[:, None]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z[seeds == 0] = hashes
    return z


def majorities(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` fingerprints over independent hashes: the bits that are set in over half of each hash's values."""
    seeds = np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros((count, 64), np.int64)
    for at in range(0, len(hashes), 255):  # so many bits add up in a byte
        mixed = remixed(hashes[at : at + 255], seeds)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(count, -1, 8), axis=2, bitorder="little")
        ones += bits.view(np.uint64).sum(1, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str | None, width: int) -> int:
    return int(majorities(shingle_hashes(text, width), 1)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp long) of every row."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {id_col: cols[id_col], "fp": [_signed(fingerprint(t, width)) for t in cols[text]]}

    return map_rows(docs, [id_col, text], run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


def embedding(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, two bits each."""
    next_bit = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(next_bit).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(next_bit).bitwiseAND(F.lit(_LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def choices(bits: int) -> list[tuple[int, ...]]:
    """The choices of groups of which two embeddings within ``bits`` share one whole."""
    return list(combinations(range(_GROUPS), _GROUPS - bits))


def grid(points: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(cell, p): the grid cells of each point; a cell is named by a hash, so a clash only adds comparisons."""
    e = embedding(F.col("p"))
    masks = [sum(0xFF << (8 * g) for g in c) for c in choices(bits)]
    return points.select(F.explode(F.array(*[F.xxhash64(F.lit(k), e.bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)])).alias("cell"), "p")


def _embed(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & np.uint64(_LOW))


def _manhattan(ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """Distance of two embeddings; counts 0 and 2 differ in the upper bit of their code alone."""
    low, high = (ea ^ eb) & np.uint64(_LOW), ((ea ^ eb) >> np.uint64(1)) & np.uint64(_LOW)
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)


def _linked(a: np.ndarray, b: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """Whether points are within the distance: the lower bound first, then the exact one."""
    return (_manhattan(_embed(a), _embed(b)) <= bits) & (np.bitwise_count(a ^ b) <= bits)


def tree(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, row) of a spanning forest of a symmetric table of links."""
    left, edges = near.any(1), []
    for root in np.flatnonzero(left):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            reach = near[front] & left
            new = np.flatnonzero(reach.any(0))
            edges += zip(front[reach[:, new].argmax(0)].tolist(), new.tolist(), strict=True)
            left[new] = False
            front = new
    return edges


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal first ``keys`` columns, as rows come sorted by them, and where each run starts."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        key = [table.column(i).to_numpy() for i in range(keys)]
        starts = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1])
        end = table.num_rows if last else int(starts[-1])
        return table.slice(0, end), starts if last else starts[:-1], table.slice(end)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 15:
                table, starts, rest = cut(False)
                held = rest.to_batches()
                rows = rest.num_rows
                if table.num_rows:
                    yield table, starts
    if held:
        yield cut(True)[:2]


def _small_pairs(starts: np.ndarray, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the same run, for all runs of 2 to ``_RUN`` rows."""
    sizes = np.diff(np.concatenate([starts, [total]]))
    keep = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= _RUN), sizes))
    run = np.repeat(np.arange(len(sizes)), sizes)[keep]
    for k in range(1, _RUN):
        at = np.flatnonzero(run[k:] == run[:-k])
        if not len(at):
            break
        yield keep[at], keep[at + k]


def _large_runs(starts: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    sizes = np.diff(np.concatenate([starts, [total]]))
    for k in np.flatnonzero(sizes > _RUN):
        yield int(starts[k]), int(sizes[k])


def _edges(a: np.ndarray, b: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), **more})


def _link_runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(a, b) links within runs (cell, block) of points p; with a column ``root``, of different components only."""
    for table, starts in _whole_runs(batches, 2):
        p = table.column("p").to_numpy().view(np.uint64)
        root = table.column("root").to_numpy() if "root" in table.column_names else None
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _small_pairs(starts, len(p)):
            ok = _linked(p[a], p[b], bits)
            if root is not None:
                ok &= root[a] != root[b]
            ends.append((a[ok], b[ok]))
        for at, n in _large_runs(starts, len(p)):
            own, near = p[at : at + n], np.zeros((n, n), bool)
            for i in range(0, n, 256):
                near[i : i + 256] = _linked(own[i : i + 256, None], own[None, :], bits)
            if root is not None:
                near &= root[at : at + n, None] != root[None, at : at + n]
            np.fill_diagonal(near, False)
            edges = np.array(tree(near), np.int64).reshape(-1, 2)
            ends.append((at + edges[:, 0], at + edges[:, 1]))
        if ends:
            a, b = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
            yield _edges(p[a].view(np.int64), p[b].view(np.int64))


def hot_cells(cells: DataFrame, wide: int = 1) -> DataFrame:
    """(cell, blocks) of cells with more than ``wide`` times ``BLOCK`` points; counted with partial sums, so a hot cell is no hot task."""
    most = wide * BLOCK
    return materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most).select("cell", F.ceil(F.col("n") / F.lit(most)).alias("blocks")))


def dealt(cells: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with their ``block``: 0 in ordinary cells; in hot ones twice, in two independent random blocks."""
    spots = F.array(*[2 * F.pmod(F.xxhash64(F.lit(r), "p"), F.col("blocks")) + r + 1 for r in range(2)])
    named = cells.join(hot, "cell", "left").withColumn("block", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(spots))).drop("blocks")
    return named.repartition("cell", "block").sortWithinPartitions("cell", "block")


def across(cells: DataFrame, chosen: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, block, side, p, root): points of the chosen cells that hold several components.

    A cell that fits one block is one run. In a larger one the blocks of its largest component meet the blocks of the
    rest, and the rest's meet each other; a component is never compared with itself.
    """
    named = materialize(cells.select("cell", "p").join(chosen.select("cell").distinct(), "cell", "left_semi").join(roots.select(F.col("node").alias("p"), "root"), "p", "left").select("cell", "p", F.coalesce("root", "p").alias("root")))
    parts = named.groupBy("cell", "root").agg(F.count("*").alias("k"))
    split = parts.groupBy("cell").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    split = split.select("cell", F.col("top.root").alias("major"), "n", F.ceil(F.col("top.k") / F.lit(BLOCK)).alias("m"), F.ceil((F.col("n") - F.col("top.k")) / F.lit(BLOCK)).alias("q"))
    zero, big = F.lit(0).cast("long"), F.lit(1 << 30)
    major = F.col("root") == F.col("major")
    own = F.when(major, F.pmod(F.xxhash64("p"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("p"), F.col("q")))
    rest = F.transform(F.sequence(zero, F.col("q") - 1), lambda j: j + F.col("m"))
    others = F.when(major, rest).otherwise(F.concat(F.sequence(zero, F.col("m") - 1), rest))
    runs = F.when(F.col("n") <= BLOCK, F.array(zero)).otherwise(F.transform(others, lambda o: F.least(F.col("side"), o) * big + F.greatest(F.col("side"), o) + 1))
    return named.join(split, "cell").withColumn("side", own).select("cell", F.explode(runs).alias("block"), "side", "p", "root")


def links(points: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect all points (p, a fingerprint each) within ``bits``."""
    cells = grid(points, bits)
    hot = hot_cells(cells)
    found = materialize(dealt(cells, hot).select("cell", "block", "p").mapInArrow(lambda batches: _link_runs(batches, bits), "a long, b long").distinct(), NARROW)
    if hot.isEmpty():
        return found
    left = across(cells.join(hot, "cell", "left_semi"), hot, components(found))
    again = left.select("cell", "block", "p", "root").repartition("cell", "block").sortWithinPartitions("cell", "block")
    return found.unionByName(materialize(again.mapInArrow(lambda batches: _link_runs(batches, bits), "a long, b long").distinct()))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node with an edge."""
    star = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, star = star, materialize(small)
        release(last)
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; a component is named by its smallest id."""
    prints = materialize(fingerprints(docs, width, id_col, text))
    points = materialize(prints.groupBy(F.col("fp").alias("p")).agg(F.min(id_col).alias("low")))
    roots = components(links(points.select("p")))
    rooted = points.join(roots, points["p"] == roots["node"], "left").select("p", "low", F.coalesce("root", "p").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(rooted.join(names, "root").select(F.col("p").alias("fp"), "component_id"))
    # both sides come from tables, so a fingerprint that many rows share is a skewed partition that Spark can split
    return prints.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Similarity of shingle sets from which two texts are near duplicates, and the share of such pairs that the grid finds.
SIMILARITY, RECALL = 0.8, 0.99
#: Chance that a bit of two fingerprints agrees at that similarity (sets of one size: cosine 2s / (1 + s)).
AGREE = 1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Fingerprints that travel with a point; the others only with points that are compared a second time.
CARRIED = 4
#: Nearest candidates of a point from which a crowded run's forest is taken.
NEAREST = 2
_TABLE = 40
#: Blocks that a run of the wide grid may hold, and near pairs of a run that are held before they are thinned.
WIDE, _HELD = 8, 1 << 20
#: Near pairs of a part of a run up to which all parts of a batch are looked at together.
_FEW = 256


def wide_grid(rows: int) -> tuple[int, int, int]:
    """(bits of a cell, cells a point, fingerprints): a cell is the popcounts of half as many segments.

    Half of all segments count one, so the densest of s segments' cells holds a share of 2^-s: at most 2^14 points. A
    longer cell is shared more seldom, so the number of cells grows with it: recall is the same at every size. Segments
    whose bits agree have one count, so the recall of bits is a lower bound for that of counts.
    """
    width = 2 * max(8, math.ceil(math.log2(max(2, rows))) - 14)
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**width))
    prints = -(-tables * width // 64)
    return width, prints * 64 // width, prints


def near_limit(prints: int) -> int:
    """Differing bits of so many fingerprints that similar texts stay below but for four standard deviations."""
    n = 64 * prints
    return int((1 - AGREE) * n + 4 * math.sqrt(AGREE * (1 - AGREE) * n))


def wide_cells(fps: np.ndarray, width: int, tables: int) -> np.ndarray:
    """Cells (row, table) of fingerprints (row, k): popcounts of ``width`` / 2 segments each, with the number of the table above them."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")[:, : width * tables]
    counts = bits[:, ::2] + bits[:, 1::2]
    value = counts.reshape(len(fps), tables, width // 2) @ (3 ** np.arange(width // 2, dtype=np.int64))
    return value + (np.arange(tables, dtype=np.int64) << _TABLE)


def unary(fps: np.ndarray) -> np.ndarray:
    """The embedding with a segment's count as that many low bits: differing bits of two are their Manhattan distance."""
    low, after = np.uint64(_LOW), fps >> np.uint64(1)
    return ((fps | after) & low) | ((fps & after & low) << np.uint64(1))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (..., k)."""
    total = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16)
    for k in range(1, a.shape[-1]):
        total += np.bitwise_count(a[..., k] ^ b[..., k])
    return total


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted) have a Jaccard similarity of ``SIMILARITY`` or more."""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)) - 1e-9:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= SIMILARITY * (len(x) + len(y) - common) - 1e-9


def set_points(docs: DataFrame, width: int, id_col: str, text: str, shape: tuple[int, int, int]) -> DataFrame:
    """(id, h, p, fps, cells) of every row with an id: a hash of its text, a digest of its shingle set, and its place."""
    bits, tables, prints = shape

    def run(cols: dict[str, list]) -> dict[str, list]:
        from xxhash import xxh3_64_intdigest

        sets = [shingle_set(t, width) for t in cols["text"]]
        fps = np.stack([majorities(s, prints) for s in sets])
        return {"id": cols["id"], "h": cols["h"], "p": [_signed(xxh3_64_intdigest(s.tobytes())) for s in sets], "fps": list(fps.view(np.int64)), "cells": list(wide_cells(fps, bits, tables))}

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return map_rows(rows, ["id", "h", "text"], run, f"id {dict(rows.dtypes)['id']}, h long, p long, fps array<long>, cells array<long>")


def _thinned(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which pairs are among the nearest of either end."""
    end, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((pair, h[pair], end))
    ranked = end[order]
    first = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    keep = np.zeros(len(a), bool)
    keep[pair[order[rank < NEAREST]]] = True
    return keep


def _forest(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the pairs, nearest first, that connect all ends without a cycle."""
    group, taken = {x: x for x in np.union1d(a, b).tolist()}, []
    order = np.argsort(h, kind="stable")
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        while group[x] != x:
            group[x] = x = group[group[x]]
        while group[y] != y:
            group[y] = y = group[group[y]]
        if x != y:
            group[x] = y
            taken.append(i)
    return np.array(taken, np.int64)


def table_masks(width: int) -> np.ndarray:
    """Bits (table, fingerprint) of those cells that the carried fingerprints hold whole."""
    table = np.arange(64 * CARRIED) // width
    return np.packbits(table == np.arange(64 * CARRIED // width)[:, None], axis=1, bitorder="little").view("<u8")


def new_pairs(a: np.ndarray, b: np.ndarray, number: np.ndarray, points: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Places of the pairs that share no cell of a table before their run's ``number``, as far as carried fingerprints tell.

    Unary codes are equal where segments' counts are, so they tell shared cells.
    """
    keep = np.arange(len(a))
    for t, mask in enumerate(masks[: number.max(initial=0)]):
        x, y = a[keep], b[keep]
        shared = number[keep] > t
        for k in np.flatnonzero(mask):
            shared &= (points[x, k] ^ points[y, k]) & mask[k] == 0
        keep = keep[~shared]
    return keep


def _candidates(batches: Iterator[pa.RecordBatch], width: int = 16) -> Iterator[pa.RecordBatch]:
    """(a, b, crowded): near pairs of runs (cell, block), by the Manhattan bound and then the Hamming distance; a crowded
    run passes on a forest of the nearest ones and its cell. A pair is left to the first cell of the carried fingerprints
    that it shares: there it is passed on, or else that cell is crowded or hot and compared again."""
    limit, masks = near_limit(CARRIED), table_masks(width)
    for table, starts in _whole_runs(batches, 2):
        cell, p = table.column("cell").to_numpy(), table.column("p").to_numpy()
        fps = np.stack([table.column(f"f{k}").to_numpy() for k in range(CARRIED)], 1).view(np.uint64)
        points = unary(fps)
        run = np.repeat(np.arange(len(starts)), sizes := np.diff(np.concatenate([starts, [len(p)]])))
        full = np.zeros(len(starts), bool)
        ends: list[tuple[np.ndarray, ...]] = []

        def near(a: np.ndarray, b: np.ndarray, fps=fps, points=points, number=cell >> _TABLE) -> tuple[np.ndarray, ...]:
            new = new_pairs(a, b, number[a], points, masks)
            a, b = a[new], b[new]
            h = differing(fps[a], fps[b])
            ok = h <= limit
            return a[ok], b[ok], h[ok]

        few: list[tuple[np.ndarray, np.ndarray]] = []  # taken together
        for a, b in _small_pairs(starts, len(p)):
            ok = differing(points[a], points[b]) <= limit
            few.append((a[ok], b[ok]))
        for at, n in _large_runs(starts, len(p)):
            own, held, step = points[at : at + n], [], max(16, min(256, (1 << 19) // n))
            for i in range(0, n, step):
                a, b = np.nonzero((differing(own[i : i + step, None], own[None, :]) <= limit) & (np.arange(n) > np.arange(i, min(n, i + step))[:, None]))
                if len(a) < _FEW:
                    few.append((at + i + a, at + b))
                    continue
                held.append(near(at + i + a, at + b))
                if sum(len(x[0]) for x in held) > _HELD:
                    a, b, h = (np.concatenate(x) for x in zip(*held, strict=True))
                    keep = _thinned(a, b, h)
                    held, full[run[at]] = [(a[keep], b[keep], h[keep])], True
            ends += held
        if few:
            ends.append(near(*(np.concatenate(x) for x in zip(*few, strict=True))))
        if not ends:
            continue
        a, b, h = (np.concatenate(x) for x in zip(*ends, strict=True))
        crowded = (full | (np.bincount(run[a], minlength=len(starts)) > NEAREST * sizes))[run[a]]
        keep = ~crowded
        thin = np.flatnonzero(crowded)
        thin = thin[_thinned(a[thin], b[thin], h[thin])]
        keep[thin[_forest(a[thin], b[thin], h[thin])]] = True
        yield _edges(p[a[keep]], p[b[keep]], crowded=np.where(crowded[keep], cell[a[keep]], -1))


def _verify_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): exactly verified links between components within runs (cell, block), nearest first, as a forest."""
    for table, starts in _whole_runs(batches, 2):
        for at, n in zip(starts.tolist(), np.diff(np.concatenate([starts, [table.num_rows]])).tolist(), strict=True):
            own = table.slice(at, n)
            p, root, side = (own.column(c).to_numpy() for c in ("p", "root", "side"))
            one_block, number = own.column("block")[0].as_py() == 0, own.column("cell")[0].as_py() >> _TABLE
            fps, cells = (np.asarray(own.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, -1) for c in ("fps", "cells"))
            fps = fps.view(np.uint64)
            points = unary(fps[:, :CARRIED])
            ends: list[tuple[np.ndarray, ...]] = []
            for i in range(0, n, 256):
                near = (differing(points[i : i + 256, None], points[None, :]) <= near_limit(CARRIED)) & (root[i : i + 256, None] != root[None, :]) & (np.arange(n) > np.arange(i, min(n, i + 256))[:, None])
                if not one_block:
                    near &= side[i : i + 256, None] != side[None, :]
                a, b = np.nonzero(near)
                a += i
                h = differing(fps[a], fps[b])
                ok = h <= near_limit(fps.shape[1])
                a, b, h = a[ok], b[ok], h[ok]
                ok = (cells[a] == cells[b]).argmax(1) == number  # a pair is verified in the first cell it shares
                ends.append((a[ok], b[ok], h[ok]))
            a, b, h = (np.concatenate(x) for x in zip(*ends, strict=True))
            order = np.argsort(h, kind="stable")
            group = {int(r): int(r) for r in root}
            sets = own.column("s").to_pylist()
            found: list[tuple[int, int]] = []
            for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
                x, y = int(root[i]), int(root[j])
                while group[x] != x:
                    x = group[x]
                while group[y] != y:
                    y = group[y]
                if x != y and similar(np.frombuffer(sets[i], "<u8"), np.frombuffer(sets[j], "<u8")):
                    group[x] = y
                    found.append((i, j))
            if found:
                i, j = np.array(found).T
                yield _edges(p[i], p[j])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs whose exact shingle sets are similar enough."""
    both = pairs.join(sets.selectExpr("p as a", "s as sa"), "a").join(sets.selectExpr("p as b", "s as sb"), "b").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return materialize(both.mapInArrow(check, "a long, b long"))


def similar_links(docs: DataFrame, prints: DataFrame, width: int, id_col: str, text: str, bits: int) -> DataFrame:
    """(a, b) digests of shingle sets that connect all sets of similarity 0.8 or more, up to the grid's recall.

    Equal sets are one point. Points that share a cell of segments' popcounts and are near over the carried fingerprints,
    by the Manhattan distance of the popcounts and then by the Hamming distance, are candidates, and each is verified by
    its exact sets. A pair comes from the first cell of ``bits`` bits that it shares. A crowded run, or a cell of several
    blocks, first passes on a forest of the nearest candidates only; what they leave in different components is compared
    again where the points meet, with all fingerprints and the exact sets at hand, so that only links leave the task.
    """
    points = materialize(prints.groupBy("p").agg(F.min(F.struct("id", "h")).alias("row"), F.first("fps").alias("fps"), F.first("cells").alias("cells")))
    cells = points.select(F.explode("cells").alias("cell"), "p", *[F.col("fps")[k].alias(f"f{k}") for k in range(CARRIED)])
    hot = hot_cells(cells.select("cell", "p"), WIDE)
    run = dealt(cells, hot).select("cell", "block", "p", *[f"f{k}" for k in range(CARRIED)])
    found = materialize(run.mapInArrow(lambda batches: _candidates(batches, bits), "a long, b long, crowded long").distinct(), NARROW)
    pairs = materialize(found.select("a", "b").distinct())
    needed = pairs.select(F.col("a").alias("p")).union(pairs.select("b")).union(cells.join(hot, "cell", "left_semi").select("p")).distinct()
    rows = points.join(needed, "p", "left_semi").select("p", "row.id", "row.h")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).join(rows, ["id", "h"]).dropDuplicates(["p"])
    sets = materialize(map_rows(texts, ["p", "text"], lambda cols: {"p": cols["p"], "s": [shingle_set(t, width).tobytes() for t in cols["text"]]}, "p long, s binary"))
    edges = _verified(pairs, sets)
    crowded = materialize(found.where("crowded >= 0").select(F.col("crowded").alias("cell")).union(hot.select("cell")).distinct())
    if crowded.isEmpty():
        return edges
    left = across(cells.select("cell", "p"), crowded, components(edges))
    whole = left.join(points.select("p", "fps", "cells"), "p").join(sets, "p").select("cell", "block", "side", "p", "root", "fps", "cells", "s")
    again = whole.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_verify_runs, "a long, b long")
    return edges.unionByName(materialize(again.distinct()))


def keep_first(docs: DataFrame, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near duplicates the row of the smallest id, with all its columns; rows without an id stay.

    Texts are linked if the similarity of their sets of ``width``-word shingles is 0.8 or more.
    """
    shape = wide_grid(docs.count())
    prints = materialize(set_points(docs, width, id_col, text, shape))
    roots = components(similar_links(docs, prints, width, id_col, text, shape[0]).distinct())
    rows = prints.select("id", "h", "p").join(roots, prints["p"] == roots["node"], "left").select("id", "h", F.coalesce("root", "p").alias("root")).distinct()
    first = rows.groupBy("root").agg(F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first")
    later = materialize(rows.join(first, "root").where("struct(id, h) <> first").select(F.col("id").alias("_id"), F.col("h").alias("_h")))
    name = "_hash" + "_" * max(map(len, docs.columns))  # no column of the documents
    hashed = docs.where(F.col(id_col).isNotNull()).withColumn(name, F.xxhash64(text))
    kept = hashed.join(later, (hashed[id_col] == later["_id"]) & (hashed[name] == later["_h"]), "left_anti").dropDuplicates([id_col, name])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.where(F.col(id_col).isNull()).select(*columns))
