"""Windows of views chained as they arrive: each is placed by the views it shares with those before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

STEP = "capture_id long, window long, s double, " + ", ".join(f"r{i} double" for i in range(9)) + ", tx double, ty double, tz double"


def chained(steps: DataFrame) -> DataFrame:
    """Each window's similarity into the first window's frame, from steps into the window before, in arrival order.

    The state of a capture is one similarity; steps of a batch are taken by window.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0]) if state.exists else np.array([1.0, *np.eye(3).reshape(-1), 0.0, 0.0, 0.0])
        s, r, t = held[0], held[1:10].reshape(3, 3), held[10:]
        rows = []
        for row in pd.concat(list(batches)).sort_values("window").itertuples(index=False):
            own = np.array(row[2:], float)
            t = s * r @ own[10:] + t
            s, r = s * own[0], r @ own[1:10].reshape(3, 3)
            rows.append((key[0], row.window, s, *r.reshape(-1), *t))
        state.update(([float(x) for x in (s, *r.reshape(-1), *t)],))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in STEP.split(", ")])

    return steps.groupBy("capture_id").applyInPandasWithState(run, STEP, "held array<double>", "append", "NoTimeout")
