"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

One model of order four per language, over the letters as they are (16-bit units of UTF-16, lower-cased) of words between
boundary marks; what is no letter parts words. The counts of all training texts are added up by Spark and smoothed on the
driver; every counted 4-gram has its place in the language's sorted hash arrays, so the models grow with what the corpus
holds. They are broadcast: 12 bytes a counted gram and language, which grow as the different 4-grams of a language do,
far slower than the text. A text takes the language of the lowest cross-entropy per symbol; a temperature fitted on a
bounded sample of training rows turns the cross-entropies into a probability, and a threshold on it rejects unsure
predictions. A word's sums are remembered, so frequent words are looked up once a task.

Edge cases: a null text or one without letters (digits, emoji, marks) gives ``und``, score 0 and ``accepted`` false. Null
languages are never learned from. Ties go to the alphabetically first language. Without training rows every text is
``und``. Very long texts, and texts without blanks, are scored whole. Extra columns are ignored. Repeated rows are scored
independently and alike; of rows that repeat an id one is used for calibration.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches
from .grams import added_up, kneser_ney

#: Labelled rows the temperature and the rejection threshold are fitted on.
CALIBRATION_ROWS = 4000
#: Share of accepted calibration rows that must be right.
ACCEPT_PRECISION = 0.99
UND = "und"
ORDER, BITS = 4, 16
#: Different words counted or remembered at a time; longer words are not kept.
REMEMBERED, KEPT_LETTERS = 200_000, 64
_CHUNK = 1 << 20
_TOKEN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; characters like fractions, which are no letters, may stand among them."""
    return _TOKEN.findall(text.lower())


def letters_of(token: str) -> list[str]:
    return [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of words between marks, and the word each belongs to; a word has one more than it has units."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = "\0\0\0" + "\0\0\0".join(words) + "\0"
    u = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    key = (u[:-3] << np.uint64(48)) | (u[1:-2] << np.uint64(32)) | (u[2:-1] << np.uint64(16)) | u[3:]
    letter = u != 0
    word = np.cumsum(letter[1:] & ~letter[:-1])[2:] - 1
    use = letter[3:] | letter[2:-1]
    return key[use], word[use]


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): 4-gram counts of all rows with a text and a language; added up per task before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        for batch in batches:
            for t, lg in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals.setdefault(lg, Counter()).update(words_of(t))
            if sum(map(len, totals.values())) > REMEMBERED:
                yield from flush(totals)
        yield from flush(totals)

    def flush(totals: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lg in list(totals):
            words = [(w, n) for token, n in totals.pop(lg).items() for w in letters_of(token)]
            if not words:
                continue
            grams, word = grams_of([w for w, _ in words])
            keys, n = added_up([(grams, np.array([n for _, n in words])[word])])
            for at in range(0, len(keys), 1 << 16):
                k = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lg] * len(k)), pa.array(k.view(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["lang", "gram", "n"])

    part = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return part.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageModels:
    """A Kneser-Ney model of each language, and a calibrated choice between them."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.models = [kneser_ney(*counts[lg], BITS, ORDER) for lg in self.languages]
        self.temperature, self.threshold = 20.0, 0.0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.languages) + 1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "sums")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def sums_of(self, tokens: list[str]) -> np.ndarray:
        """Log-probability by language and number of symbols of each token, a row each."""
        words = [(w, i) for i, token in enumerate(tokens) for w in letters_of(token)]
        out = np.zeros((len(tokens), len(self.languages) + 1))
        grams, word = grams_of([w for w, _ in words])
        owner = np.array([i for _, i in words], np.int64)[word] if words else word
        for at in range(0, len(grams), _CHUNK):
            kinds, g = np.unique(grams[at : at + _CHUNK], return_inverse=True)  # far fewer than there are
            o = owner[at : at + _CHUNK]
            for j, model in enumerate(self.models):
                out[:, j] += np.bincount(o, np.log(model.probabilities(kinds))[g], minlength=len(tokens))
            out[:, -1] += np.bincount(o, minlength=len(tokens))
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol by language (nats), and whether a text has a letter."""
        if len(self.known) > REMEMBERED:
            self._forget()
        found = [words_of(t) if t else [] for t in texts]
        fresh = list({w for ws in found for w in ws if len(w) <= KEPT_LETTERS}.difference(self.known))
        if fresh:
            first, need = len(self.known), len(self.known) + len(fresh)
            if need > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((need, self.sums.shape[1]))])
            self.sums[first:need] = self.sums_of(fresh)
            self.known.update(zip(fresh, range(first, need), strict=True))
        total = np.zeros((len(texts), len(self.languages) + 1))
        for i, ws in enumerate(found):
            rows = [self.known.get(w) for w in ws]
            if None in rows:
                total[i] = self.sums_of([w for w, r in zip(ws, rows, strict=True) if r is None]).sum(0)
                rows = [r for r in rows if r is not None]
            total[i] += self.sums[rows].sum(0)
        size = total[:, -1]
        return -total[:, :-1] / np.maximum(size, 1)[:, None], size > 0

    def probabilities(self, entropies: np.ndarray) -> np.ndarray:
        z = -self.temperature * (entropies - entropies.min(1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def calibrate(self, entropies: np.ndarray, truth: np.ndarray) -> None:
        """Temperature of the highest likelihood, and the lowest threshold at which accepted rows are right enough."""
        if not len(truth):
            return
        best = -np.inf
        for t in np.geomspace(2, 200, 40):
            self.temperature, before = float(t), self.temperature
            p = self.probabilities(entropies)[np.arange(len(truth)), truth]
            value = np.log(np.maximum(p, 1e-9)).mean() - 1e-4 * t
            if value > best:
                best = value
            else:
                self.temperature = before
        p = self.probabilities(entropies)
        right = (p.argmax(1) == truth)[order] if len(order := np.argsort(-p.max(1), kind="stable")) else np.zeros(0, bool)
        good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= ACCEPT_PRECISION)
        self.threshold = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
        if len(good) and good[-1] == len(right) - 1:
            self.threshold = min(self.threshold, 0.5)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, probability, acceptance and lowest cross-entropy of each text."""
        if not self.languages:
            n = len(texts)
            return [UND] * n, np.zeros(n), np.zeros(n, bool), np.zeros(n)
        entropies, letters = self.cross_entropies(texts)
        p = self.probabilities(entropies)
        pick = p.argmax(1)
        score = np.where(letters, np.clip(p.max(1), 0, 1), 0.0)
        langs = [self.languages[j] if ok else UND for j, ok in zip(pick, letters, strict=True)]
        return langs, score, letters & (score >= self.threshold), np.where(letters, entropies.min(1), 0.0)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", calibration_rows: int = CALIBRATION_ROWS) -> LanguageModels:
    """Counts of every training row, then the models on the driver."""
    rows = count_grams(train, text, lang).toArrow()
    names, grams, n = rows.column("lang").combine_chunks().dictionary_encode(), rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    counts = {}
    for k, lg in enumerate(names.dictionary.to_pylist()):
        own = names.indices.to_numpy() == k
        keys = grams[own].view(np.uint64)
        order = np.argsort(keys)
        counts[lg] = keys[order], n[own][order]
    model = LanguageModels(counts)
    if not counts:
        return model
    labelled = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    ids = labelled.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(calibration_rows)  # a bounded, documented sample
    held, place = train.sparkSession.sparkContext.broadcast(model), {lg: j for j, lg in enumerate(model.languages)}

    def measure(cols: dict[str, list]) -> dict[str, list]:
        entropies, letters = held.value.cross_entropies(cols["text"])
        return {"id": cols["id"], "truth": [place[str(v)] if ok else -1 for v, ok in zip(cols["lang"], letters, strict=True)], "entropies": entropies.tolist()}

    sample = labelled.join(F.broadcast(ids.distinct()), id_col, "left_semi").select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    scored = map_rows(sample, ["id", "text", "lang"], measure, f"id {dict(sample.dtypes)['id']}, truth int, entropies array<double>").where("truth >= 0")
    found = scored.groupBy("id").agg(F.min(F.struct("truth", "entropies")).alias("r")).select("r.*").collect()  # one row an id
    model.calibrate(np.array([r.entropies for r in found]).reshape(-1, len(model.languages)), np.array([r.truth for r in found], int))
    return model


def identify(docs: DataFrame, model: LanguageModels, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted, cross_entropy) of every row; only the id and the text are read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols: dict[str, list]) -> dict[str, list]:
        langs, score, accepted, entropy = held.value.predict(cols[text])
        return {id_col: cols[id_col], "lang_pred": langs, "score": score, "accepted": accepted, "cross_entropy": entropy}

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs, [id_col, text], run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean, cross_entropy double")
