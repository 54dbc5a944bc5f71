"""Streaming debounce with a cap: a burst ends after a quiet gap or once it has lasted so long, whichever is first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def capped(events: DataFrame, key: str = "key", ts: str = "ts", gap_ms: int = 500, cap_ms: int = 2000, late: str = "10 seconds") -> DataFrame:
    """key, first, last, n of closed bursts. Only the open burst of a key is state: three numbers."""

    def close(k, first: int, last: int, n: int) -> tuple:
        return k, pd.Timestamp(first, unit="ms"), pd.Timestamp(last, unit="ms"), n

    def run(at: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append(close(at[0], *state.get))
            state.remove()
        else:
            times = sorted(int(t.timestamp() * 1000) for b in batches for t in b[ts])
            held = state.getOption
            for t in times:
                if held is None:
                    held = (t, t, 1)
                elif t - held[1] >= gap_ms or t - held[0] >= cap_ms:
                    out.append(close(at[0], *held))
                    held = (t, t, 1)
                else:
                    held = (held[0], max(held[1], t), held[2] + 1)
            if held is not None:
                state.update(held)
                state.setTimeoutTimestamp(max(min(held[1] + gap_ms, held[0] + cap_ms), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "first", "last", "n"])

    kind = dict(events.dtypes)[key]
    return events.select(key, ts).withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, first timestamp, last timestamp, n long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
