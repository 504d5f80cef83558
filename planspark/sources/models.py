"""Models that this library does not run: what each must return, and how its recorded results enter.

A model is any function from rows of inputs to rows of its contract. Results are kept in a folder by the digest of what
they were made from, and a broken or missing record counts as none. ``replay`` never runs a model.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_POSE = ", ".join(f"m{i}{j} double" for i in range(3) for j in range(4))
#: Columns that each kind of model returns.
CONTRACTS = {
    "views": f"view int, {_POSE}, fx double, fy double, cx double, cy double, width int, height int, depth array<double>, conf array<double>",
    "depth": "frame int, width int, height int, depth array<double>",
    "chain": f"frame int, {_POSE}",
    "structure": f"piece int, frame int, {_POSE}",
    "matches": "a string, pa int, b string, pb int, xa double, ya double, xb double, yb double",
    "detections": "image int, class string, x0 int, y0 int, x1 int, y1 int, confidence double, note string",
    "frames": "frame int, width int, height int, ts double, content binary",
}


def key_of(kind: str, settings: dict[str, Any], inputs: list[str]) -> str:
    """Digest of a model's kind, settings and inputs; any change is another key."""
    return hashlib.sha256(json.dumps([kind, settings, inputs], sort_keys=True).encode()).hexdigest()[:24]


def conforms(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a contract's columns; missing ones or other types are an error."""
    wanted = rows.sparkSession.createDataFrame([], CONTRACTS[kind]).dtypes
    have = dict(rows.dtypes)
    if wrong := [f"{n} {k}" for n, k in wanted if have.get(n) != k]:
        raise TypeError(f"a {kind} model must return {', '.join(wrong)}")
    return rows.select(*[n for n, _ in wanted])


def result(spark: SparkSession, folder: str, kind: str, key: str, policy: str = "replay_or_live", model: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Recorded rows of a model, or new ones that are then recorded, as the policy has it."""
    from planspark.sources.capture import checkpointed

    path = f"{folder}/{kind}/{key}"
    if policy == "live" or model is None:
        if model is None:
            if policy == "live":
                raise ValueError(f"there is no {kind} model to run")
            return checkpointed(None, spark, path)
        from planspark.sources.capture import replace_table

        return replace_table(conforms(model(), kind), spark, path)
    if policy == "replay":
        return checkpointed(None, spark, path)
    return checkpointed(lambda: conforms(model(), kind), spark, path)
