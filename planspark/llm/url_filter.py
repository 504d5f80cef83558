"""URL filters: rules first, then a character model ratio.

Two variable-order Markov models, of accepted and of rejected URLs, are learned from the URLs that rules decide. Each
interpolates orders 0 to 4 over the URL's bytes with Witten-Bell weights: the more different bytes followed a context, the
more the shorter context counts. Every counted run of five bytes is kept in sorted hash arrays, so the models grow with
the corpus. A URL that no rule decides is judged by the length-normalised difference of the two log-likelihoods; a
logistic fit on a bounded sample of different decided URLs calibrates where that difference is even.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; without ``://`` the whole
text is judged, and null or empty ones have difference 0. Where rules decide nothing, or only one way, undecided URLs are
allowed. Of rules that fit, the longest wins, then the first. Very long URLs are read whole. Repeated rows are judged
alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches
from .grams import BackoffModel, added_up, witten_bell

#: Decided URLs the calibration is fitted on.
CALIBRATION_ROWS = 4000
BITS, ORDER = 8, 5
#: Counted runs that a task holds before it passes them on.
HELD = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and a path prefix."""

    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host.lower(), slash + path)

    @property
    def name(self) -> str:
        return self.host + self.path


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(_lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pick = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, pick) if found is None else found.when(fits, pick)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams_of(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of five bytes ending at each byte of the URLs without their scheme, and the URL each belongs to."""
    parts = []
    for url in urls:
        text = url or ""
        at = text.find("://")
        parts.append((text[at + 3 :] if at >= 0 else text).encode("utf-8", "surrogatepass").replace(b"\0", b"\1"))
    mark = b"\0" * (ORDER - 1)
    u = np.frombuffer(mark + mark.join(parts), np.uint8).astype(np.uint64)
    key = np.zeros(max(0, len(u) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        key = (key << np.uint64(BITS)) | u[k : k + len(key)]
    return key[u[ORDER - 1 :] != 0], np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def count_grams(decided: DataFrame) -> DataFrame:
    """(verdict, gram, n) of decided URLs (url, verdict); added up per task before the shuffle."""
    small_batches(decided.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            verdicts = np.array(batch.column(1).to_pylist())
            keys, url = grams_of(batch.column(0).to_pylist())
            for v in set(verdicts.tolist()):
                own = keys[(verdicts == v)[url]]
                held[v] = [added_up([*held.get(v, []), (own, np.ones(len(own), np.int64))])]
            if sum(len(k) for [(k, _)] in held.values()) > HELD:
                yield from flush(held)
        yield from flush(held)

    def flush(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for v in list(held):
            [(keys, n)] = held.pop(v)
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["verdict", "gram", "n"])

    return decided.select("url", "verdict").mapInArrow(run, "verdict string, gram long, n long").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))


@dataclass
class RatioModel:
    """Models of accepted and of rejected URLs, and the calibrated line over the mean of their log-ratio."""

    allow: BackoffModel | None
    block: BackoffModel | None
    slope: float = 1.0
    shift: float = 0.0

    def means(self, urls: list[str | None]) -> np.ndarray:
        if self.allow is None or self.block is None:
            return np.zeros(len(urls))
        keys, url = grams_of(urls)
        kinds, at = np.unique(keys, return_inverse=True)
        ratio = (np.log(self.allow.probabilities(kinds)) - np.log(self.block.probabilities(kinds)))[at]
        return np.bincount(url, ratio, minlength=len(urls)) / np.maximum(np.bincount(url, minlength=len(urls)), 1)

    def probability(self, means: np.ndarray) -> np.ndarray:
        if self.allow is None or self.block is None:
            return np.ones(len(means))
        return 1 / (1 + np.exp(-np.clip(self.slope * means + self.shift, -50, 50)))

    def calibrate(self, means: np.ndarray, accepted: np.ndarray) -> None:
        """Ridge logistic regression of the verdict on the mean ratio, by Newton steps; both verdicts weigh the same."""
        w = np.where(accepted, 0.5 / max(1, accepted.sum()), 0.5 / max(1, (~accepted).sum())) * len(means)
        x, beta = np.stack([means, np.ones(len(means))], 1), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
            gradient = x.T @ (w * (accepted - p)) - 1e-2 * beta
            hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            beta = beta + np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        self.slope, self.shift = float(beta[0]), float(beta[1])


def fit(decided: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> RatioModel:
    """Model of all decided URLs (url, verdict)."""
    rows = count_grams(decided).toArrow()
    verdicts, grams, n = rows.column("verdict").to_numpy(zero_copy_only=False), rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    models = {}
    for v in ("allow", "block"):
        keys = grams[verdicts == v]
        if not len(keys):
            return RatioModel(None, None)
        order = np.argsort(keys)
        models[v] = witten_bell(keys[order], n[verdicts == v][order], BITS, ORDER)
    model = RatioModel(models["allow"], models["block"])
    sample = decided.select("url", "verdict").distinct().orderBy(F.xxhash64("url"), "url").limit(calibration_rows).collect()
    model.calibrate(model.means([r.url for r in sample]), np.array([r.verdict == "allow" for r in sample]))
    return model


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, accept_probability) of every row."""
    base = pages.select(F.col(id_col), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = base.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select(id_col, "url", "host", "path", "found.rule", F.col("found.verdict").alias("verdict"))
    model = pages.sparkSession.sparkContext.broadcast(fit(ruled.where("verdict is not null")))

    def run(cols: dict[str, list]) -> dict[str, list]:
        p = model.value.probability(model.value.means(cols["url"]))
        verdict = [v if v is not None else "allow" if x >= 0.5 else "block" for v, x in zip(cols["verdict"], p, strict=True)]
        return {c: cols[c] for c in (id_col, "host", "path", "rule")} | {"verdict": verdict, "accept_probability": p}

    return map_rows(ruled, [id_col, "url", "host", "path", "rule", "verdict"], run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string, accept_probability double")
