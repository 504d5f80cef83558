"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of word stems (first four or five letters, so that inflected and derived forms count) is learned from a bounded
sample of labelled training rows: stems over-represented in toxic texts. A text's features are the densities of words with such a stem, how many of them stand near a second-person word, and the rates of
capitals, punctuation and obfuscated spellings. Trees of a fixed depth are boosted on the logistic loss over histogram
bins; a held-back part of the sample fits a monotone map from margins to probabilities by pooling adjacent violators.

Edge cases: null and empty texts have all features zero and are scored like any other row. Without labelled rows, or
with one class only, every score is the share of toxic labels (0 without labels). Very long texts are read whole.
Of rows that repeat an id one is learned from. Repeated rows score alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, labelled_sample, map_rows

#: Labelled rows the lexicon and the trees are fitted on.
SAMPLE_ROWS = 20_000
#: Letters of a stem.
STEM = (4, 5)
#: Least share of the toxic sample texts that hold a stem, and least log-odds of it; copies of one text stay below.
STEM_SHARE, STEM_ODDS = 0.004, 2.5
TREES, DEPTH, BINS, RATE, RIDGE = 60, 3, 32, 0.2, 1.0
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 4
# Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes vosotros tú ti".split())
# Letters that are often written as other characters.
_UNMASK = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W\d_]+[*@$#!0-9]+[^\W\d_]+")
FEATURES = ("hits_per_word", "hits", "distinct_hits", "strong_hits", "near_second_person", "second_person_rate", "masked_hits", "masked_rate", "capital_rate", "exclaim_rate", "punct_rate", "log_words")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(texts: list[str | None], lexicon: dict[str, float]) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    strong = {w for w, s in lexicon.items() if s >= 5.0}
    known = frozenset(lexicon)
    for i, text in enumerate(texts):
        if not text:
            continue
        words = words_of(text)
        n = max(1, len(words))
        letters = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        masked = [m.lower() for m in _MASKED.findall(text)]
        hit_masks = sum(m.translate(_UNMASK)[:n] in known for m in masked for n in STEM)
        present = known.intersection([w[: STEM[0]] for w in words]) | known.intersection([w[: STEM[1]] for w in words])
        hits = near = persons = strong_hits = 0
        if present:
            at = [k for k, w in enumerate(words) if w[: STEM[0]] in present or w[: STEM[1]] in present]
            hits = len(at)
            strong_hits = sum(words[k][: STEM[0]] in strong or words[k][: STEM[1]] in strong for k in at)
            near = sum(not SECOND_PERSON.isdisjoint(words[max(0, k - NEAR) : k + NEAR + 1]) for k in at)
        if not SECOND_PERSON.isdisjoint(words):
            persons = sum(map(SECOND_PERSON.__contains__, words))
        size = max(1, int(letters.sum()))
        out[i] = (hits / n, hits, len(present), strong_hits, near, persons / n, hit_masks, len(masked) / n, letters[65:91].sum() / size, letters[33] / size, letters[33:48].sum() / size, np.log1p(len(words)))
    return out


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """All stems with high smoothed log-odds of standing in toxic texts of the sample (text, label).

    Each stands in a certain share of the toxic texts, so there are no more than their different stems over that share.
    """

    def run(cols: dict[str, list]) -> dict[str, list]:
        seen = {0: Counter(), 1: Counter()}
        for t, y in zip(cols["text"], cols["label"], strict=True):
            seen[int(y > 0)].update({w[:n] for w in words_of(t) for n in STEM if len(w) >= n})
        both = list(seen[0].keys() | seen[1].keys())
        return {"word": both, "clean": [seen[0][w] for w in both], "toxic": [seen[1][w] for w in both]}

    counts = map_rows(sample, ["text", "label"], run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = sample.agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = totals.toxic or 0, (totals.n or 0) - (totals.toxic or 0)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    top = counts.where(F.col("toxic") >= max(3.0, STEM_SHARE * toxic)).withColumn("odds", odds).where(F.col("odds") > STEM_ODDS)
    return {r.word: r.odds for r in top.collect()}


@dataclass
class Tree:
    """A complete binary tree: a feature and a bin for each inner node, a value for each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf(self, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), int)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[np.arange(len(binned)), self.feature[node]] > self.cut[node])
        return node - len(self.feature)


@dataclass
class BoostedTrees:
    """Binned gradient boosting on the logistic loss with second-order leaves."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    start: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)))[:-1] for j in range(x.shape[1])]
        # values above zero are rare in many columns: cut between distinct values of those too
        self.edges = [np.unique(np.concatenate([e, np.quantile(p, np.linspace(0, 0.9, 8)) - 1e-12])) if len(p := x[x[:, j] > 0, j]) else e for j, e in enumerate(self.edges)]
        binned = self.bins(x)
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree.value[tree.leaf(binned)]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> Tree:
        inner = 2**DEPTH - 1
        feature, cut = np.zeros(inner, int), np.full(inner, 1 << 30)
        node, width = np.zeros(len(binned), int), max((len(e) for e in self.edges), default=0) + 1
        for first in [2**d - 1 for d in range(DEPTH)]:
            level, local = first + 1, node - first
            best = np.full(level, 1e-9)
            for j in range(binned.shape[1]):
                cell = local * width + binned[:, j]
                gs, hs = (np.bincount(cell, w, minlength=level * width).reshape(level, width) for w in (g, h))
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                at = gain.argmax(1)
                top = gain[np.arange(level), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + level][better] = j
                cut[first : first + level][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, w, minlength=2**DEPTH) for w in (g, h))
        return Tree(feature, cut, -RATE * gs / (hs + RIDGE))

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned, margin = self.bins(x), np.full(len(x), self.start)
        for t in self.trees:
            margin += t.value[t.leaf(binned)]
        return margin


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone least-squares fit: adjacent blocks that violate the order are pooled."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest x, highest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = high
    knots = [(v, (s + 0.01) / (w + 0.02)) for s, w, low, high in blocks for v in sorted({low, high})]
    at, level = np.array([k for k, _ in knots]), np.maximum.accumulate(np.array([v for _, v in knots])) if knots else np.zeros(0)
    return at, level


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return np.clip(np.interp(self.trees.margins(features(texts, self.lexicon)), *self.knots), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Model of a bounded sample of labelled rows; three quarters grow trees, the rest calibrates them."""
    sample = labelled_sample(docs, labels, label, rows, id_col, text)
    lexicon = learn_lexicon(sample)

    def measure(cols: dict[str, list]) -> dict[str, list]:
        return {id_col: cols[id_col], "x": features(cols["text"], lexicon).tolist(), "label": cols["label"]}

    kind = dict(docs.dtypes)[id_col]
    measured = map_rows(sample, [id_col, "text", "label"], measure, f"`{id_col}` {kind}, x array<double>, label int")
    found = measured.groupBy(id_col).agg(F.min(F.struct("x", "label")).alias("r")).orderBy(id_col).select("r.*").collect()  # one row an id
    x = np.array([r.x for r in found]).reshape(-1, len(FEATURES))
    y = np.array([float(r.label > 0) for r in found])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(lexicon, None, (np.zeros(0), np.zeros(0)), float(y.mean()) if len(y) else 0.0)
    held = np.arange(len(y)) % 4 == 3
    if held.sum() < 50 or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    trees = BoostedTrees().fit(x[~held], y[~held])
    use = held if held.any() else ~held
    return ToxicityModel(lexicon, trees, isotonic(trees.margins(x[use]), y[use]), float(y.mean()))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; only the id and the text are read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols: dict[str, list]) -> dict[str, list]:
        p = held.value.score(cols[text])
        return {id_col: cols[id_col], "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return map_rows(docs, [id_col, text], run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, [text], lambda cols: (held.value.score(cols[text]) < 0.5).tolist())
