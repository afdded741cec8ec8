"""Streaming forms of the keyed folds: anchored windows and duplicates, with state that outlives batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelane.operators.anchored import anchored_numbers, dedup_status


def anchored_windows(events: DataFrame, key: str, time: str, id: str, width: int) -> DataFrame:
    """(key, id, time, window): as the batch form numbers them. A batch's rows of a key are taken in order of time and id.

    The state is one key's open anchor and its number. Rows are applied in the order in which batches deliver
    them; none is dropped for coming late.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["time", "id"], kind="stable")
        anchor, number = state.get if state.exists else (None, 0)
        window, anchor, number = anchored_numbers(rows["time"].to_numpy(), width, anchor, number)
        state.update((anchor, number))
        yield rows.assign(window=window)[["key", "id", "time", "window"]]

    slim = events.select(F.col(key).alias("key"), F.col(id).alias("id"), F.col(time).alias("time"))
    return slim.groupBy("key").applyInPandasWithState(
        fold, f"key {dict(slim.dtypes)['key']}, id long, time long, window long", "anchor long, number long", "append", GroupStateTimeout.NoTimeout
    )


def dedup(events: DataFrame, key: str, time: str, id: str, ok: str, ttl: int, delay: str = "1 day") -> DataFrame:
    """(key, id, time, status): as the batch form tells them. The state is the time of the key's last success.

    It goes when the stream is more than ttl and delay past that time, when it can make no duplicate any more. Rows
    that come more than delay late aren't judged.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["time", "id"], kind="stable")
        status, last = dedup_status(rows["time"].to_numpy(), rows["ok"].to_numpy(), ttl, state.get[0] if state.exists else None)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(status=status)[["key", "id", "time", "status"]]

    slim = events.select(
        F.col(key).cast("long").alias("key"), F.col(id).alias("id"), F.col(time).alias("time"), F.expr(ok).alias("ok"),
        F.timestamp_micros(time).alias("at")
    ).withWatermark("at", delay)
    return slim.groupBy("key").applyInPandasWithState(
        fold, "key long, id long, time long, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )
