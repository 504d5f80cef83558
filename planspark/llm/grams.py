"""Back-off models of symbol runs in sorted hash arrays; languages and URLs use them.

A run of symbols (a gram) is one unsigned number, a fixed number of bits a symbol, the last symbol lowest. Hashes are the
product with an odd number, which no two grams share, so a lookup is exact. Models hold every counted gram: they grow
with what the corpus has.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


class HashArray:
    """Rows in the order of their keys' hashes, found by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = keys.astype(np.uint64) * _ODD
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found): what is not found has a value without meaning."""
        if not len(self.hashes):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        hashes = keys * _ODD
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return self.values[at], self.hashes[at] == hashes


class BackoffModel:
    """Probability of a gram's last symbol after the others, interpolated over ever shorter contexts."""

    def __init__(self, bits: int, unknown: float):
        self.bits, self.unknown = bits, unknown
        self.grams: list[HashArray] = []  # probabilities of the counted grams of 1, 2, ... symbols
        self.contexts: list[HashArray] = []  # weight of the shorter context after 1, 2, ... symbols

    def add(self, grams: np.ndarray, p: np.ndarray, contexts: np.ndarray | None = None, weights: np.ndarray | None = None) -> None:
        self.grams.append(HashArray(grams, p))
        if contexts is not None:
            self.contexts.append(HashArray(contexts, weights))

    def _low(self, grams: np.ndarray, symbols: int) -> np.ndarray:
        return grams if self.bits * symbols >= 64 else grams & np.uint64((1 << (self.bits * symbols)) - 1)

    def probabilities(self, grams: np.ndarray, symbols: int | None = None) -> np.ndarray:
        symbols = len(self.grams) if symbols is None else symbols
        if not symbols:
            return np.full(len(grams), self.unknown)
        p, found = self.grams[symbols - 1].find(self._low(grams, symbols))
        p = p.astype(float)
        miss = np.flatnonzero(~found)
        if len(miss):
            rest = grams[miss]
            p[miss] = self.probabilities(rest, symbols - 1)
            if symbols > 1:
                weight, known = self.contexts[symbols - 2].find(self._low(rest >> np.uint64(self.bits), symbols - 1))
                p[miss] *= np.where(known, weight, 1.0)
        return p


def suffixes(grams: np.ndarray, n: np.ndarray, bits: int, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Last ``symbols`` of grams, and the sum of their counts."""
    keys, at = np.unique(grams & np.uint64((1 << (bits * symbols)) - 1), return_inverse=True)
    return keys, np.bincount(at, n, minlength=len(keys))


def _after(grams: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Contexts of grams; which one each gram has; how often each occurs, and with how many last symbols."""
    contexts, at = np.unique(grams >> np.uint64(bits), return_inverse=True)
    return contexts, at, np.bincount(at, n, minlength=len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float)


def discount(n: np.ndarray) -> float:
    """Absolute discount out of how many grams occur once and twice."""
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.75


def kneser_ney(grams: np.ndarray, n: np.ndarray, bits: int, order: int) -> BackoffModel:
    """Interpolated Kneser-Ney: shorter grams count the different symbols before them; a symbol never seen has half a count."""
    levels = [(grams, n.astype(float))]
    for symbols in range(order - 1, 0, -1):
        longer = levels[0][0]
        levels.insert(0, suffixes(longer, np.ones(len(longer)), bits, symbols))
    keys, counts = levels[0]
    total = counts.sum() + 0.5 * (len(keys) + 1)
    model = BackoffModel(bits, 0.5 / total)
    p = (counts + 0.5) / total
    model.add(keys, p)
    for symbols in range(2, order + 1):
        shorter, below = keys, p
        keys, counts = levels[symbols - 1]
        contexts, at, mass, kinds = _after(keys, counts, bits)
        d = discount(counts)
        weight = d * kinds / mass
        p = np.maximum(counts - d, 0) / mass[at] + weight[at] * below[np.searchsorted(shorter, keys & np.uint64((1 << (bits * (symbols - 1))) - 1))]
        model.add(keys, p, contexts, weight)
    return model


def witten_bell(grams: np.ndarray, n: np.ndarray, bits: int, order: int) -> BackoffModel:
    """Witten-Bell: the more different symbols followed a context, the more the shorter context counts."""
    p = keys = None
    model = BackoffModel(bits, 1 / (1 << bits))
    for symbols in range(1, order + 1):
        shorter, below = keys, p
        keys, counts = suffixes(grams, n, bits, symbols) if symbols < order else (grams, n.astype(float))
        contexts, at, mass, kinds = _after(keys, counts, bits)
        weight = kinds / (mass + kinds)
        if symbols == 1:
            p = counts / (mass + kinds)[at] + weight[at] * model.unknown
            model.unknown *= float(weight[0])
            model.add(keys, p)
        else:
            p = counts / (mass + kinds)[at] + weight[at] * below[np.searchsorted(shorter, keys & np.uint64((1 << (bits * (symbols - 1))) - 1))]
            model.add(keys, p, contexts, weight)
    return model


def added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of grams (grams, n) put together."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)
