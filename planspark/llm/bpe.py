"""Byte-level BPE encoding and decoding through a minimal acyclic transducer of frequent words.

A first pass counts the pre-tokens of the whole corpus; the most frequent ones are compiled, sorted, into a
deterministic acyclic automaton whose equal suffixes are shared. Each edge carries the number of words that sort before
it, so a walk also yields the word's rank, and the rank points at the word's ids. The automaton travels as one flat
buffer and is memory-mapped by the workers; all new words of a batch walk it together, a byte at a time. Words outside
it are merged exactly by the ranks of the vocabulary file. Decoding maps ids to bytes and the bytes to UTF-8 text, with
replacement characters for broken sequences.

Edge cases: a null or empty text has no ids and decodes to the empty text. Special tokens written out in a text become
their ids, as the library's encoder does it. Very long texts are encoded whole. An empty table gives an empty result and
an empty lexicon. Repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import gc
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, release, small_batches

#: Words in the lexicon.
LEXICON_WORDS = 1 << 16
#: Longest word, in bytes, that the lexicon holds.
LEXICON_BYTES = 64
#: Distinct words, and distinct pre-tokens, a worker remembers; a memory is emptied when full.
REMEMBERED = 600_000
#: Widths, in bytes, of the groups of words that are merged together; longer words are merged one by one.
MERGED_TOGETHER = (4, 6, 8, 11, 15, 20, 28, 40)
#: Distinct chunks a counting task holds before it passes their counts on.
COUNTED = 300_000
# The pre-tokenisation rule of the public byte-level BPE vocabulary, with white space spelled out.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RULE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: A single blank between two non-blanks always starts a pre-token.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_ADJACENT = re.compile(r"\s\s")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: printable Latin-1 as is, the rest from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Ranks and bytes of a tokenizer file, and exact merging."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_letters().items()}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = [ids[c] for _, c in sorted(byte_letters().items())]
        self.ranks: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left], ids[right]] = rank
            self.joined.append(ids[left + right])
        self.rule = regex.compile(RULE)
        keys = np.array([(a << 32) | b for a, b in self.ranks] or [-1], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([*self.ranks.values()] or [0], np.int32)[order]
        self._joined, self._of_byte = np.array([*self.joined, 0], np.int32), np.array(self.of_byte, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._ranks[at], len(self.joined))

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit numbers, of many pre-tokens: those of similar length merge in step."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        group = np.searchsorted(MERGED_TOGETHER, lengths)
        for i in np.flatnonzero(group == len(MERGED_TOGETHER)).tolist():
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        for g, width in enumerate(MERGED_TOGETHER):
            own = np.flatnonzero(group == g)
            rows, sizes = own.tolist(), lengths[own]
            if not rows:
                continue
            letters = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(-1, width)
            ids, counts = self._merge_rows(self._of_byte[letters], sizes)
            flat = ids.astype("<u4").tobytes()
            for k, (i, n) in enumerate(zip(rows, counts.tolist(), strict=True)):
                out[i] = flat[4 * k * width : 4 * (k * width + n)]
        return out

    def _merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none, (n, width) = len(self.joined), ids.shape
        columns = np.arange(width)
        rank = np.full((n, width + 1), none, np.int32)  # of the pair that starts at a column
        rank[:, : width - 1] = np.where(columns[1:] < lengths[:, None], self._rank(ids[:, :-1], ids[:, 1:]), none)
        ids, lengths, live = np.pad(ids, ((0, 0), (0, 1))), lengths.copy(), np.arange(n)
        while len(live):
            own = rank[live]
            at = own.argmin(1)
            low = own[np.arange(len(live)), at]
            going = low < none
            live, at, low, own = live[going], at[going], low[going], own[going]
            rows = np.arange(len(live))
            source = columns + (columns > at[:, None])
            word = np.take_along_axis(ids[live], source, 1)
            word[rows, at] = self._joined[low]
            source = columns + (columns >= at[:, None])
            own[:, :width] = np.take_along_axis(own, source, 1)
            lengths[live] -= 1
            right = np.where(at + 1 < lengths[live], self._rank(word[rows, at], word[rows, np.minimum(at + 1, width - 1)]), none)
            left = np.where(at > 0, self._rank(word[rows, np.maximum(at - 1, 0)], word[rows, at]), none)
            own[rows, at] = right
            own[rows[at > 0], at[at > 0] - 1] = left[at > 0]
            ids[live, :width], rank[live] = word, own
        return ids[:, :width], lengths

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the leftmost adjacent pair of the lowest rank is merged until none is left."""
        of_byte, ranks, none = self.of_byte, self.ranks, len(self.joined)
        ids = [of_byte[b] for b in word]
        if len(ids) > 200:
            return self._merge_long(ids)
        rank = [ranks.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while rank and (low := min(rank)) < none:
            at = rank.index(low)
            ids[at : at + 2] = [self.joined[low]]
            del rank[at]
            if at:
                rank[at - 1] = ranks.get((ids[at - 1], ids[at]), none)
            if at < len(rank):
                rank[at] = ranks.get((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked positions, for long runs without blanks."""
        import heapq

        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = self.joined[rank], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]


class Lexicon:
    """The transducer as flat arrays: sorted edge keys (state << 8 | byte), targets, words before an edge, final states, ids."""

    NAMES = ("keys", "targets", "before", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update({k: arrays[k] for k in self.NAMES})

    @classmethod
    def compile(cls, words: Iterable[bytes], vocabulary: Vocabulary) -> Lexicon:
        """Sorted words are added one after another; the states behind the common prefix are shared with equal ones."""
        words = sorted(set(words) - {b""})
        register: dict[tuple, int] = {}
        edges: list[tuple[tuple[int, int], ...]] = []  # by finished state: (byte, target), ...
        finals: list[bool] = []
        path: list[list] = [[False, []]]  # open states along the last word: final, edges so far
        labels: list[int] = []

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, own = path.pop()
                signature = final, tuple(own)
                state = register.get(signature)
                if state is None:
                    state = register[signature] = len(edges)
                    edges.append(tuple(own))
                    finals.append(final)
                path[-1][1].append((labels.pop(), state))

        last = b""
        for w in words:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            close(common)
            for b in w[common:]:
                labels.append(b)
                path.append([False, []])
            path[-1][0] = True
            last = w
        close(0)
        root = len(edges)
        edges.append(tuple(path[0][1]))
        finals.append(path[0][0])
        size = [0] * len(edges)  # words below a state; a target is always closed before its source
        keys, targets, before = [], [], []
        for state, own in enumerate(edges):
            total = int(finals[state])
            for b, target in own:
                keys.append(((root - state) << 8) | b)  # the root is state 0
                targets.append(root - target)
                before.append(total)
                total += size[target]
            size[state] = total
        order = np.argsort(np.array(keys, np.uint32)) if keys else np.zeros(0, int)
        ids = [vocabulary.merge(w) for w in words]
        return cls({
            "keys": np.array(keys, np.uint32)[order], "targets": np.array(targets, np.uint32)[order], "before": np.array(before, np.uint32)[order],
            "final": np.array(finals[::-1], np.uint8), "offsets": np.cumsum([0] + [len(x) for x in ids]).astype(np.uint32), "ids": np.array([i for x in ids for i in x], np.uint32),
        })

    def to_bytes(self) -> bytes:
        head, body = [], b""
        for k in self.NAMES:
            a = self.__dict__[k]
            head.append((k, a.dtype.str, len(a)))
            body += a.tobytes() + b"\0" * (-a.nbytes % 8)
        text = json.dumps(head).encode()
        return len(text).to_bytes(8, "little") + text + b" " * (-len(text) % 8) + body

    @classmethod
    def mapped(cls, blob: bytes) -> Lexicon:
        """Memory-mapped arrays over a file that has no name any more, so nothing stays behind on the machine."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            view = mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ)
        n = int.from_bytes(view[:8], "little")
        at, arrays = 8 + n + -n % 8, {}
        for name, kind, length in json.loads(view[8 : 8 + n]):
            arrays[name] = np.frombuffer(view, kind, length, at)
            at += arrays[name].nbytes + -arrays[name].nbytes % 8
        return cls(arrays)

    def walk(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, or -1; all words step along together."""
        rank = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return rank
        lengths = np.array([len(w) for w in words])
        fits = np.flatnonzero((lengths > 0) & (lengths <= LEXICON_BYTES))
        width = int(lengths[fits].max()) if len(fits) else 0
        letters = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in fits), np.uint8).reshape(-1, width) if width else np.zeros((0, 0), np.uint8)
        state, seen, rows = np.zeros(len(fits), np.uint32), np.zeros(len(fits), np.int64), np.arange(len(fits))
        for k in range(width):
            key = (state[rows] << np.uint32(8)) | letters[rows, k]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == key
            rows, at = rows[ok], at[ok]
            state[rows] = self.targets[at]
            seen[rows] += self.before[at]
            ended = lengths[fits[rows]] == k + 1
            done = rows[ended]
            done = done[self.final[state[done]] > 0]
            rank[fits[done]] = seen[done]
            rows = rows[~ended]
        return rank

    def ids_of(self, rank: int) -> bytes:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tobytes()


class Codec:
    """Encodes whole texts to little-endian 32-bit ids, and decodes them."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, bytes] = {}  # ids of a word with a blank before it
        self.parts: dict[str, bytes] = {}  # ids of a pre-token
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.by_id, self.decimal = (np.array([*x, None], object)[:-1] for x in (vocabulary.bytes, [b"%d" % i for i in range(len(vocabulary.bytes))]))

    def _learn(self, words: set[str], others: set[str]) -> dict[str, bytes]:
        """Ids of new words, and of other chunks: pre-tokens walk the automaton, and what it lacks is merged."""
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        rule = self.vocabulary.rule.findall
        plain = [w for w in words if w.isalpha()]  # one pre-token each
        single = [" " + w for w in plain]
        cut, own = {w: rule(" " + w) for w in words.difference(plain)}, {c: rule(c) for c in others}
        fresh = list(set(single).union(*cut.values(), *own.values()).difference(self.parts))
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        rank = self.lexicon.walk(raw)
        offsets, flat = (self.lexicon.offsets.astype(np.int64) * 4).tolist(), self.lexicon.ids.tobytes()
        for i in np.flatnonzero(rank >= 0).tolist():
            self.parts[fresh[i]] = flat[offsets[rank[i]] : offsets[rank[i] + 1]]
        unseen = np.flatnonzero(rank < 0).tolist()
        for i, ids in zip(unseen, self.vocabulary.merge_many([raw[i] for i in unseen]), strict=True):
            self.parts[fresh[i]] = ids
        part = self.parts.__getitem__
        self.known.update(zip(plain, map(part, single), strict=True))
        for w, ps in cut.items():
            self.known[w] = b"".join(map(part, ps))
        return {c: b"".join(map(part, ps)) for c, ps in own.items()}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        gc.disable()  # strings and bytes only: no cycles to look for
        try:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            words, others = set(), set()
            found = [self._segments(t or "") for t in texts]
            for parts in found:
                for first, rest in parts:
                    words.update(rest)
                    others.add(first)
            special = {s: np.array([i], "<u4").tobytes() for s, i in self.vocabulary.special.items()}
            others = self._learn(words.difference(self.known), others - special.keys()) | special
            known = self.known.__getitem__
            out = []
            for parts in found:
                flat = []
                for first, rest in parts:
                    flat.append(others[first])
                    flat += map(known, rest)
                out.append(np.frombuffer(b"".join(flat), "<u4"))
            return out
        finally:
            gc.enable()

    def _segments(self, text: str) -> list[tuple[str, list[str]]]:
        """(first chunk, words each with one blank before them): special tokens stand alone."""
        if not text:
            return []
        if self.special is not None and any(s in text for s in self.vocabulary.special):
            return [(p, []) if p in self.vocabulary.special else x for p in self.special.split(text) if p for x in self._segments_plain(p)]
        return self._segments_plain(text)

    @staticmethod
    def _segments_plain(text: str) -> list[tuple[str, list[str]]]:
        parts = text.split(" ") if not (_ADJACENT.search(text) or text[0].isspace() or text[-1].isspace()) else _BETWEEN.split(text)
        return [(parts[0], parts[1:])]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(self.by_id[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")


def count_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word binary, n): pre-token counts of all texts, added up per task before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = _vocabulary(path).rule
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(t.split(" "))
            if len(held) > COUNTED:
                yield flush(held, rule)
                held = Counter()
        yield flush(held, rule)

    def flush(held: Counter, rule) -> pa.RecordBatch:
        words: Counter = Counter()
        for w, n in held.items():
            for p in (" " + w,) if w.isalpha() else rule.findall(" " + w):
                words[p] += n
        kept = [(w, n) for w, n in ((p.encode("utf-8", "surrogatepass"), n) for p, n in words.items()) if len(w) <= LEXICON_BYTES]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    rows = docs.where(F.col(text) != "").select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


_vocabularies: dict[str, Vocabulary] = {}
_codecs: dict[tuple, Codec] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS, text: str = "text") -> Lexicon:
    """Lexicon of the corpus's most frequent words, ``words`` at most; words that occur once are not among them.

    A histogram over 64 steps a doubling of the count, at most some 4,000 rows, says from which step on that many words
    are left, so no task ranks words. Words of a step come in together or not at all; the others are merged exactly.
    """
    counts = materialize(count_words(docs, path, text).where("n > 1").withColumn("step", F.floor(64 * F.log2("n"))))
    least, left = None, words
    for row in sorted(counts.groupBy("step").agg(F.count("*").alias("kinds")).collect(), reverse=True):
        if row.kinds > left:
            break
        least, left = row.step, left - row.kinds
    top = counts.where(F.col("step") >= least).select("word").toArrow().column("word").to_pylist() if least is not None else []
    release(counts)
    return Lexicon.compile(top, _vocabulary(path))


def map_codec(docs: DataFrame, path: str, lexicon: Lexicon, columns: list[str], fn, schema: str) -> DataFrame:
    """``map_rows`` with a codec: ``fn(codec, columns)``."""
    blob = docs.sparkSession.sparkContext.broadcast(lexicon.to_bytes())
    key = path, id(blob), len(blob.value)

    def run(cols: dict[str, list]) -> dict[str, list]:
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(_vocabulary(path), Lexicon.mapped(blob.value))
        return fn(_codecs[key], cols)

    return map_rows(docs, columns, run, schema)


def encode(docs: DataFrame, path: str, lexicon: Lexicon, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    kind = dict(docs.dtypes)[id_col]
    return map_codec(docs, path, lexicon, [id_col, text], lambda codec, cols: {id_col: cols[id_col], "ids": [x.astype(np.int32) for x in codec.encode(cols[text])]}, f"`{id_col}` {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, lexicon: Lexicon, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids decode to the empty text."""
    kind = dict(rows.dtypes)[id_col]
    return map_codec(rows, path, lexicon, [id_col, ids], lambda codec, cols: {id_col: cols[id_col], "text": [codec.decode(x or []) for x in cols[ids]]}, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, path: str, lexicon: Lexicon, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): a round trip of every text without keeping the ids."""
    from hashlib import sha256

    kind = dict(docs.dtypes)[id_col]

    def run(codec: Codec, cols: dict[str, list]) -> dict[str, list]:
        out = {id_col: cols[id_col], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in codec.encode(cols[text]):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha256(b",".join(codec.decimal[ids].tolist())).hexdigest())
            out["decoded_sha256"].append(sha256(codec.decode(ids).encode()).hexdigest())
        return out

    return map_codec(docs, path, lexicon, [id_col, text], run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
