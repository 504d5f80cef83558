"""Structured Streaming: running voxels, sessions, windows, job states and chained transforms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planspark.functions.scalars import cell


def running_voxels(points: DataFrame, size: float) -> DataFrame:
    """Sums and counts by voxel, for update mode; the same plan as the batch fuse."""
    keys = [cell(F.col(c), size).alias(f"k{c}") for c in "xyz"]
    return points.groupBy(*keys).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("z").alias("sz"), F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Spans of a user's events without a longer gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling_counts(events: DataFrame, width: str, kind: str, late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sliding_peak(metrics: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    marked = metrics.withWatermark("ts", late) if metrics.isStreaming else metrics
    return marked.groupBy(F.window("ts", width, step).alias("w")).agg(F.max("value").alias("peak")).select(F.col("w.start").alias("start"), "peak")


def latest_states(events: DataFrame) -> DataFrame:
    """Current state of each job: that of its newest event; ties go to the later id."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def chained_scale(windows: DataFrame) -> DataFrame:
    """Global scale of each window (capture_id, window, ratio) as the running product of its predecessors' ratios, in arrival order."""
    from pyspark.sql.streaming.state import GroupState

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scale = state.get[0] if state.exists else 1.0
        rows = []
        for r in pd.concat(list(batches)).sort_values("window").itertuples():
            scale *= r.ratio
            rows.append((key[0], r.window, scale))
        state.update((scale,))
        yield pd.DataFrame(rows, columns=["capture_id", "window", "scale"])

    return windows.groupBy("capture_id").applyInPandasWithState(run, "capture_id long, window long, scale double", "scale double", "append", "NoTimeout")
