"""Sequence packing: shortest-pack-first over the length histogram.

Documents become token ids plus an end id; what exceeds a sequence is cut into full pieces and a rest. Only the
histogram of piece lengths (at most ``max_tokens`` rows) reaches the driver. There lengths are placed longest first into
the packing pattern with the fewest tokens so far, or open a new pattern; a pattern has a count, so thousands of equal
sequences are one entry. Patterns are then joined back to pieces by (length, rank). Ranks need no sort: a piece knows its
ordinal among equal lengths of its task, and a window over the tasks of one length adds the offset.

Edge cases: a null or empty text is the end id alone. Very long texts are cut, never truncated. Equal texts and repeated
rows are packed one by one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
import zlib
from array import array
from collections.abc import Callable
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize

MAX_TOKENS = 4096
#: Distinct words, and distinct pre-tokens, whose ids a worker remembers; a memory is emptied when full.
REMEMBERED_WORDS, REMEMBERED_PARTS = 900_000, 700_000
_tokenizers: dict = {}
_BLANKS = re.compile("[\n\t\r]")
_MARKS = frozenset(".,!?:;|")


def _plain(text: str) -> str:
    """The text lower-cased where that changes no id: the tokenizer does the same after composing characters."""
    return text.lower() if "\u0130" not in text and "\u03a3" not in text and "<|" not in text and is_normalized("NFC", text) else text


class _Parts(dict):
    """Ids, as bytes, of the letters of words; asks the tokenizer for what is new."""

    def __init__(self, tokenizer):
        self.encode = tokenizer.encode

    def __missing__(self, part: str) -> bytes:
        if len(self) > REMEMBERED_PARTS:
            self.clear()
        ids = self[part] = array("I", self.encode(part, add_special_tokens=False).ids).tobytes()
        return ids


class _Words(dict):
    """Ids of blank-separated words; a word of letters and one mark is put together from its two parts."""

    def __init__(self, parts: _Parts):
        self.parts = parts

    def __missing__(self, word: str) -> bytes:
        stem = word[:-1]
        ids = self[word] = self.parts[stem] + self.parts[word[-1]] if word[-1:] in _MARKS and stem.isalpha() else self.parts[word]
        return ids


def _word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encoder of whole texts by blank-separated words; exact for tokenizers that drop white space before merging."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _tokenizers[path] = _Words(_Parts(tokenizer))
    known = _tokenizers[path]

    def encode(texts: list[str]) -> list[bytes]:
        gc.disable()  # strings and bytes only: no cycles to look for
        try:
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            get = known.__getitem__
            return [b"".join(map(get, _BLANKS.sub(" ", _plain(t)).split(" "))) for t in texts]
        finally:
            gc.enable()

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, task, ordinal) of every piece of every document."""
    kind = dict(docs.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()
    state: dict = {}

    def run(cols: dict[str, list]) -> dict[str, list]:
        from pyspark import TaskContext

        context = TaskContext.get()
        attempt = (context.stageId(), context.partitionId(), context.attemptNumber())
        if state.get("attempt") != attempt:
            state.clear()
            state.update(attempt=attempt, seen=np.zeros(max_tokens + 1, np.int64))
        seen, out = state["seen"], {k: [] for k in ("id", "start", "length", "crc", "total", "ordinal")}
        for doc_id, ids in zip(cols[id_col], _word_encoder(tokenizer_path)([t or "" for t in cols[text]]), strict=True):
            ids += end
            total = len(ids) // 4
            for at in range(0, total, max_tokens):
                n = min(max_tokens, total - at)
                for k, v in zip(out, (doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total, int(seen[n])), strict=True):
                    out[k].append(v)
                seen[n] += 1
        return {id_col: out["id"], "start": out["start"], "length": out["length"], "ids_crc32": out["crc"], "doc_tokens": out["total"], "task": [attempt[1]] * len(out["id"]), "ordinal": out["ordinal"]}

    return map_rows(docs, [id_col, text], run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, ordinal long")


def pack_histogram(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order, count); a length joins the shortest pattern that it fits, longest lengths first."""
    heap: list[tuple[int, int, tuple, int]] = []  # tokens, tie-break, lengths, count
    made = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown = []
        while left:
            if heap and heap[0][0] + length <= max_tokens:
                tokens, _, lengths, count = heapq.heappop(heap)
                room = (max_tokens - tokens) // length
                used = min(left, count)
                if used < count:
                    heapq.heappush(heap, (tokens, made := made + 1, lengths, count - used))
                    grown.append((tokens + length, made := made + 1, lengths + (length,), used))
                    left -= used
                else:
                    # several rounds at once while this pattern stays the shortest one
                    bound = heap[0][0] if heap else max_tokens
                    rounds = max(1, min(room, left // count, (bound - tokens) // length))
                    heapq.heappush(heap, (tokens + rounds * length, made := made + 1, lengths + (length,) * rounds, count))
                    left -= rounds * count
            else:
                for g in grown:
                    heapq.heappush(heap, g)
                if grown and heap[0][0] + length <= max_tokens:
                    grown = []
                    continue
                grown = []
                each = max_tokens // length
                full, rest = divmod(left, each)
                # new patterns hold one each: shorter lengths still to come may fill them better than equal ones
                heapq.heappush(heap, (length, made := made + 1, (length,), max(1, full + (rest > 0))))
                left -= full + (rest > 0)
        for g in grown:
            heapq.heappush(heap, g)
    return [(lengths, count) for _, _, lengths, count in sorted(heap)]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), first sequence and offset of each slot of each pattern."""
    next_rank: dict[int, int] = {}
    keys, sequences, offsets = [], [], []
    first = 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            keys.append((length << 40) | rank)
            sequences.append(first)
            offsets.append(offset)
            next_rank[length] = rank + count
            offset += length
        first += count
    order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, int)
    return np.array(keys, np.int64)[order], np.array(sequences, np.int64)[order], np.array(offsets, np.int64)[order]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    cut = materialize(pieces(docs, tokenizer_path, end_id, max_tokens, id_col, text))
    tasks = cut.groupBy("length", "task").agg((F.max("ordinal") + 1).alias("n"))
    histogram = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    table = docs.sparkSession.sparkContext.broadcast(slots(pack_histogram(histogram, max_tokens)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("ordinal"))
    kept = [id_col, "start", "length", "ids_crc32", "doc_tokens"]

    def place(cols: dict[str, list]) -> dict[str, list]:
        keys, sequences, offsets = table.value
        rank, length = np.array(cols["rank"], np.int64), np.array(cols["length"], np.int64)
        at = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
        return {c: cols[c] for c in kept} | {"sequence_id": sequences[at] + rank - (keys[at] & ((1 << 40) - 1)), "offset": offsets[at]}

    kind = dict(docs.dtypes)[id_col]
    return map_rows(ranked, [*kept, "rank"], place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
