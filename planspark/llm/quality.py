"""Quality rules: a linear-chain conditional random field labels the lines of a text, and the content share decides.

Each line has a few binary features (shouting, symbols, table bars, repetition, length, closing mark, digits). Weights of
a two-state chain, content and boilerplate, are fitted by gradient ascent on the log-likelihood of all lines of a bounded
sample of labelled texts. Lines take their text's label at first; then the lines of good texts that the chain is sure to
be boilerplate are marked so, and the chain is fitted again, so its transitions see texts of both kinds of line. Viterbi
decoding finds the best sequence for each text; a text is kept if enough of its word characters stand in content lines
and it passes the base rules. Sequences are cut into segments whose 2x2 products are combined, so a text of n lines takes
about sqrt(n) steps, and texts of any length are decoded, and learned from, whole.

Edge cases: a null or empty text has no words and fails the base rules. Lines without a word are not labelled. Without
labelled rows, or with one class only, every line is content. Of rows that repeat an id one is learned from. Repeated
rows are judged alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, labelled_sample, map_rows

#: Labelled rows the chain is fitted on.
SAMPLE_ROWS = 6000
#: Probability of boilerplate from which a line of a good text counts as such when the chain is fitted again.
SURE = 0.95
#: Share of word characters in content lines from which a text is kept.
KEEP_SHARE = 0.5
#: Base rules: fewest words, and largest percentage of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
STEPS, RATE, RIDGE = 150, 0.5, 1e-3
FEATURES = ("bias", "capitals_30", "capitals_60", "symbols_3", "symbols_10", "bars_2", "exclaim_2", "repeated", "words_under_4", "closed", "digits_10", "long_words", "punct_12", "link")
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _mask(values: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(values)] = 1
    return table


_BLANK = _mask([9, 10, 11, 12, 13, 32])
_STARTS = _mask([*range(0x80), *range(0xC0, 0x100)])  # first byte of a code point
_CLASSES = {"symbols": _mask(SYMBOLS), "capitals": _mask(range(65, 91)), "lower": _mask(range(97, 123)), "bars": _mask(b"|"), "exclaim": _mask(b"!"), "digits": _mask(b"0123456789"), "punct": _mask(b"!\"'(),-./:;?")}


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    if size == n:
        return 0
    if size < 1 << 20:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1].astype(np.int64)
        keys = pairs * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


@dataclass
class Lines:
    """The lines with a word of one text: features, word characters, and the base counts of the text."""

    x: np.ndarray
    chars: np.ndarray
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def measure(text: str | None) -> Lines:
    """Features of the lines and base counts of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        data = np.frombuffer(raw, np.uint8)
        return Lines(np.zeros((0, len(FEATURES)), bool), np.zeros(0, np.int64), 0, 0, int(_CLASSES["symbols"][data].sum()), 0, 0)
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    repeated = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        if line in seen:
            repeated[i] = True
        else:
            seen.add(line)
    data = np.frombuffer(raw + b"\n", np.uint8)
    starts = np.cumsum([0] + [len(x) + 1 for x in lines[:-1]])
    count = lambda table: np.add.reduceat(table[data], starts, dtype=np.int64)
    blank = _BLANK[data]
    begins = np.concatenate([blank[:1] == 0, (blank[1:] == 0) & (blank[:-1] == 1)])
    n_words = np.add.reduceat(begins, starts, dtype=np.int64)
    chars = np.add.reduceat(_STARTS[data] & (1 - blank), starts, dtype=np.int64)
    some = n_words > 0
    c = {k: count(t) for k, t in _CLASSES.items()}
    size, cased = np.maximum(chars, 1), np.maximum(c["capitals"] + c["lower"], 1)
    trimmed = [x.rstrip() for x in lines]
    closed = np.array([x[-1:] in b".!?:" and x != b"" for x in trimmed])
    link = np.array([b"://" in x or b"@" in x or b"www." in x for x in lines])
    x = np.stack([
        np.ones(len(lines), bool), c["capitals"] > 0.3 * cased, c["capitals"] > 0.6 * cased, c["symbols"] > 0.03 * size, c["symbols"] > 0.1 * size, c["bars"] >= 2,
        c["exclaim"] >= 2, repeated, n_words < 4, closed, c["digits"] > 0.1 * size, chars > 9 * np.maximum(n_words, 1), c["punct"] > 0.12 * size, link,
    ], 1)
    return Lines(x[some], chars[some], len(words), int(chars.sum()), int(c["symbols"].sum()), int((repeated & some).sum()), repeated_words(words))


class Segments:
    """Sequences that lie one after another, cut into segments of equal size; all segments step along together."""

    def __init__(self, lengths: np.ndarray):
        self.size = max(1, int(np.sqrt(lengths.max())))
        count = -(-lengths // self.size)
        text = np.repeat(np.arange(len(lengths)), count)
        self.last = np.cumsum(count) - 1
        self.rank = np.arange(len(text)) - (self.last - count + 1)[text]
        at = (self.rank * self.size)[:, None] + np.arange(self.size)
        self.live = at < lengths[text][:, None]
        self.line = np.where(self.live, (np.cumsum(lengths) - lengths)[text][:, None] + at, 0)
        order = np.argsort(self.rank, kind="stable")
        self.by_rank = np.split(order, np.cumsum(np.bincount(self.rank))[:-1])


class LineField:
    """Two-state linear-chain field: state 0 is content, 1 is boilerplate."""

    def __init__(self):
        self.emit = np.zeros((len(FEATURES), 2))
        self.move = np.zeros((2, 2))
        self.fitted = False

    def fit(self, texts: list[np.ndarray], labels: np.ndarray) -> LineField:
        """Lines have the text's label, then boilerplate lines of good texts their own; equal texts are one that weighs more."""
        if not len(texts) or labels.min() == labels.max():
            return self
        kinds: dict[tuple, list] = {}
        for t, y in zip(texts, labels.tolist(), strict=True):
            kinds.setdefault((t.tobytes(), y), [t, y, 0])[2] += 1
        x = np.concatenate([t for t, _, _ in kinds.values()]).astype(float)
        lengths = np.array([len(t) for t, _, _ in kinds.values()])
        truth = np.repeat([y for _, y, _ in kinds.values()], lengths)
        weight = np.repeat(np.array([n for _, _, n in kinds.values()]) / len(texts) / lengths, lengths)
        parts = Segments(lengths)
        self._ascend(x, truth, weight, parts, lengths)
        one, _ = self._marginals(x @ self.emit, parts, lengths)
        sure = (truth == 0) & (one[:, 1] >= SURE)
        if sure.any():
            self._ascend(x, np.where(sure, 1, truth), weight, parts, lengths)
        self.fitted = True
        return self

    def _ascend(self, x: np.ndarray, truth: np.ndarray, weight: np.ndarray, parts: Segments, lengths: np.ndarray) -> None:
        inner = np.ones(len(x), bool)
        inner[np.cumsum(lengths) - 1] = False
        inner = np.flatnonzero(inner)
        goal = np.eye(2)[truth]
        want = np.einsum("l,la,lb->ab", weight[inner], goal[inner], goal[inner + 1])
        steps = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for _ in range(STEPS):
            one, two = self._marginals(x @ self.emit, parts, lengths)
            grads = x.T @ ((goal - one) * weight[:, None]) - RIDGE * self.emit, want - np.einsum("l,lab->ab", weight[inner], two[inner]) - RIDGE * self.move
            for s, g, w in zip(steps, grads, (self.emit, self.move), strict=True):
                s += g**2
                w += RATE * g / np.sqrt(s + 1e-8)

    def _marginals(self, score: np.ndarray, parts: Segments, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each line's state, and of each line's state with the next line's."""
        here = np.exp(score - score.max(1, keepdims=True))
        move = np.exp(self.move - self.move.max())
        step = np.where(parts.live[..., None, None], move * here[parts.line][..., None, :], np.eye(2))
        first = parts.rank == 0
        step[first, 0] = here[parts.line[first, 0]][:, None, :]
        total = step[:, 0]
        for t in range(1, parts.size):
            total = total @ step[:, t]
            total /= total.max((1, 2), keepdims=True)
        ahead, behind = np.full((len(total), 2), 0.5), np.ones((len(total), 2))
        for k in range(1, len(parts.by_rank)):
            s = parts.by_rank[k]
            v = np.einsum("sa,sab->sb", ahead[s - 1], total[s - 1])
            ahead[s] = v / v.sum(1, keepdims=True)
        for k in range(len(parts.by_rank) - 1, 0, -1):
            s = parts.by_rank[k]
            v = np.einsum("sab,sb->sa", total[s], behind[s])
            behind[s - 1] = v / v.sum(1, keepdims=True)
        forward, back = np.zeros((*parts.live.shape, 2)), np.zeros((*parts.live.shape, 2))
        for t in range(parts.size):
            v = np.einsum("sa,sab->sb", ahead, step[:, t])
            forward[:, t] = ahead = v / v.sum(1, keepdims=True)
        for t in range(parts.size - 1, -1, -1):
            back[:, t] = behind
            v = np.einsum("sab,sb->sa", step[:, t], behind)
            behind = v / v.sum(1, keepdims=True)
        a, b = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        a[parts.line[parts.live]], b[parts.line[parts.live]] = forward[parts.live], back[parts.live]
        one = a * b
        two = np.zeros((len(score), 2, 2))
        two[:-1] = a[:-1, :, None] * move * (here[1:] * b[1:])[:, None, :]  # across the end of a text it is not used
        return one / one.sum(1, keepdims=True), two / np.maximum(two.sum((1, 2), keepdims=True), 1e-300)

    def viterbi(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Best state sequence of each text."""
        out = [np.zeros(len(t), np.int8) for t in texts]
        some = [i for i, t in enumerate(texts) if len(t)]
        if not self.fitted or not some:
            return out
        lengths = np.array([len(texts[i]) for i in some])
        score = np.concatenate([texts[i] for i in some]) @ self.emit
        parts = Segments(lengths)
        stay = np.array([[0.0, -np.inf], [-np.inf, 0.0]])
        step = np.where(parts.live[..., None, None], self.move + score[parts.line][..., None, :], stay)
        first = parts.rank == 0
        step[first, 0] = score[parts.line[first, 0]][:, None, :]  # a sequence comes from state 0, which costs nothing
        best = np.where(first[:, None], np.array([0.0, -np.inf]), 0.0)
        total = step[:, 0]
        for t in range(1, parts.size):
            total = (total[:, :, :, None] + step[:, t, None, :, :]).max(2)
        for k in range(1, len(parts.by_rank)):
            s = parts.by_rank[k]
            best[s] = (best[s - 1][:, :, None] + total[s - 1]).max(1)
        came = np.zeros((*parts.live.shape, 2), np.int8)
        leave = np.zeros((len(total), 2))
        value = best
        for t in range(parts.size):
            reach = value[:, :, None] + step[:, t]
            came[:, t], value = reach.argmax(1), reach.max(1)
        leave[:] = value
        # where each state at a segment's end came from at its start, then the states at all ends
        start = np.tile(np.array([0, 1], np.int8), (len(total), 1))
        rows = np.arange(len(total))
        for t in range(parts.size - 1, -1, -1):
            start = np.take_along_axis(came[:, t], start.astype(np.int64), 1)
        state = np.zeros(len(total), np.int64)
        state[parts.last] = leave[parts.last].argmax(1)
        for k in range(len(parts.by_rank) - 1, 0, -1):
            s = parts.by_rank[k]
            state[s - 1] = start[s, state[s]]
        path = np.zeros(len(score), np.int8)
        for t in range(parts.size - 1, -1, -1):
            live = parts.live[:, t]
            path[parts.line[live, t]] = state[live]
            state = came[rows, t, state].astype(np.int64)
        ends = np.cumsum(lengths)
        for i, e, n in zip(some, ends, lengths, strict=True):
            out[i] = path[e - n : e]
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text") -> LineField:
    """Field of all lines of a bounded sample of labelled texts (label 1 is good)."""
    sample = labelled_sample(docs, labels, label, rows, id_col, text)

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {id_col: cols[id_col], "x": [np.packbits(measure(t).x, axis=1).tobytes() for t in cols["text"]], "label": cols["label"]}

    measured = map_rows(sample, [id_col, "text", "label"], run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, x binary, label int")
    found = measured.groupBy(id_col).agg(F.min(F.struct("x", "label")).alias("r")).orderBy(id_col).select("r.*").collect()  # one row an id
    packed = -(-len(FEATURES) // 8)
    texts = [np.unpackbits(np.frombuffer(r.x, np.uint8).reshape(-1, packed), axis=1)[:, : len(FEATURES)].astype(bool) for r in found]
    use = [i for i, t in enumerate(texts) if len(t)]
    return LineField().fit([texts[i] for i in use], np.array([int(found[i].label < 1) for i in use], int))


def verdicts(found: list[Lines], field: LineField, keep_share: float) -> tuple[list[bool], list[float], list[bool]]:
    """Base rules failed, content share, and kept, of each text."""
    failed = [f.n_words < MIN_WORDS or 100 * f.n_repeat_words > MAX_REPEAT_PERCENT * f.n_words for f in found]
    paths = field.viterbi([f.x for f in found])
    share = [float(f.chars[p == 0].sum() / max(1, f.word_chars)) for f, p in zip(found, paths, strict=True)]
    return failed, share, [not b and s >= keep_share for b, s in zip(failed, share, strict=True)]


def keep_good(docs: DataFrame, field: LineField, keep_share: float = KEEP_SHARE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    return filter_rows(docs, [text], lambda cols: verdicts([measure(t) for t in cols[text]], held.value, keep_share)[2])


def judge(docs: DataFrame, field: LineField, keep_share: float = KEEP_SHARE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base counts, base_failed, content_share, kept) of every row; only the id and the text are read."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = [measure(t) for t in cols[text]]
        failed, share, kept = verdicts(found, held.value, keep_share)
        out = {k: [getattr(f, k) for f in found] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        return {id_col: cols[id_col]} | out | {"base_failed": failed, "content_share": share, "kept": kept}

    return map_rows(docs, [id_col, text], run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
