"""Keyed state with a time to live, as a stream; the batch form is ``live_state`` in ``parchment.operators.derivation``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def expiring_state(events: DataFrame, lives: dict[str, int], otherwise: int, key: str = "user_id", kind: str = "event_type", at: str = "ts", late: str = "0 seconds") -> DataFrame:
    """(key, kind, last_ms, ends_ms, live): a row whenever a key's state is renewed, and one with live false when it ran out.

    ``lives`` has the seconds for which a kind counts.  State is one time a key and kind, and is dropped when the watermark,
    ``late`` behind the newest event, passes its end; events may come in any order and in any batches.
    """

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        life = 1000 * lives.get(name[1], otherwise)
        row = lambda last, live: pd.DataFrame({key: [name[0]], kind: [name[1]], "last_ms": [last], "ends_ms": [last + life], "live": [live]})
        held = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield row(held, False)
            return
        last = max([*(int(f["_ms"].max()) for f in frames), *([] if held is None else [held])])
        if last + life <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield row(last, False)
            return
        state.update((last,))
        state.setTimeoutTimestamp(last + life)
        yield row(last, True)

    timed = events.select(key, kind, F.col(at).cast("timestamp").alias(at)).withWatermark(at, late).withColumn("_ms", F.unix_millis(at))
    ddl = f"{key} {dict(events.dtypes)[key]}, {kind} string, last_ms long, ends_ms long, live boolean"
    return timed.groupBy(key, kind).applyInPandasWithState(fold, ddl, "last long", "update", GroupStateTimeout.EventTimeTimeout)


def live_at(rows: DataFrame, at_ms: int, key: str = "user_id", kind: str = "event_type") -> DataFrame:
    """(key, kind, last_ms) of what the stream's rows say is live at an instant that isn't before its watermark.

    Rows merge by their latest time, so rows that come twice or late don't matter; an end that passed is an end whether or
    not the stream has said so yet.
    """
    last = rows.groupBy(key, kind).agg(F.max(F.struct("last_ms", "ends_ms")).alias("x"))
    return last.where(F.col("x.ends_ms") >= at_ms).select(key, kind, "x.last_ms")
