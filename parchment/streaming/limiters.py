"""Structured Streaming forms of the windowed counters.

The batch forms are in ``parchment.operators.forum``; both must agree on the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fixed_window_counts(events: DataFrame, key: str = "user_id", at: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, starts, used): calls of each key in each tumbling window; windows close ``late`` behind the newest event.

    State is one count a key and open window; the watermark drops closed ones.
    """
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), key).agg(F.count("*").alias("used")).select(key, F.col("window.start").alias("starts"), "used")


def sliding_log_stream(events: DataFrame, limit: int, seconds: float, key: str = "user_id", at: str = "ts", order: str = "event_id") -> DataFrame:
    """(order, key, allowed) by the sliding log; state is the accepted times of a key, ``limit`` at most.

    Events of one key must arrive in order of time between triggers; inside a trigger they are sorted.  A key that is quiet
    for as long as a call counts has no call left that counts, and its state is dropped.
    """
    from collections import deque

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else ())
        frame = pd.concat(list(frames)).sort_values(["_at", order])
        allowed = []
        for t in frame["_at"].to_numpy():
            while log and t - log[0] > seconds:
                log.popleft()
            allowed.append(len(log) < limit)
            if allowed[-1]:
                log.append(float(t))
        state.update((list(log),))
        state.setTimeoutDuration(int(seconds * 1000) + 1)
        yield pd.DataFrame({order: frame[order], key: frame[key], "allowed": allowed})

    rows = events.select(order, key, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_at"))
    return rows.groupBy(key).applyInPandasWithState(fold, f"{order} long, {key} long, allowed boolean", "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
