"""The request queue over a stream: one small state per host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "host string, id long, t long, dispatched long, waited long"
STATE = "free_at long"


def dispatch_stream(requests: DataFrame, delay_ms: int, cooldown_cap_ms: int = 30_000):
    """requests: host, id, t (ms), throttled, cooldown_ms, cancelled. Emits dispatched and waited.

    Calls of a micro-batch are taken in the order of t and id. Cancelled calls
    take no slot; a throttled one holds the next back for its cooldown.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else -(1 << 62)
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        out = []
        for r in rows[~rows.cancelled].itertuples(index=False):
            at = max(free, r.t)
            hold = min(max(int(r.cooldown_ms), 0), cooldown_cap_ms) if r.throttled else 0
            free = at + max(delay_ms, hold)
            out.append((key[0], r.id, r.t, at, at - r.t))
        state.update((free,))
        yield pd.DataFrame(out, columns=["host", "id", "t", "dispatched", "waited"])

    return requests.groupBy("host").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")
