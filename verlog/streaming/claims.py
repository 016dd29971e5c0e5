"""Streaming claims: the first writer of a key wins until its claim expires.

The state of a key is the expiry of its accepted claim. Within a micro-batch rows are taken in the
order of their positions; across batches, in the order of arrival. A claim that has expired is kept
until the watermark passes its expiry, so rows up to `delay` late are judged by it; then its timer removes it.
Rows later than that are left out, as everywhere behind a watermark. Claims for good stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, pos long, ts_ms long, expires_at_ms long"


def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    until = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("pos")
    taken = []
    for pos, ts, ttl in zip(rows["pos"], rows["ts_ms"], rows["ttl_ms"], strict=True):
        if until is None or until != 0 and ts >= until:
            until = int(ts + ttl) if ttl else 0
            taken.append((key[0], pos, ts, until))
    if until is not None:
        state.update((until,))
        if until:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs()) + 1)
    yield pd.DataFrame(taken, columns=["key", "pos", "ts_ms", "expires_at_ms"])


def claims(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The accepted rows of a stream of (key, pos, ts_ms, ttl_ms)."""
    # times count from 1 ms on, as the first watermark is at 0
    timed = stream.withColumn("at", F.timestamp_millis(F.col("ts_ms") + 1)).withWatermark("at", delay)
    return timed.groupBy("key").applyInPandasWithState(accept, OUT, "until long", "append", GroupStateTimeout.EventTimeTimeout)
