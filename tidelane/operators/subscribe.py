"""Subscriptions to processed events by topic prefix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def external(events: DataFrame) -> DataFrame:
    """The flat form that subscribers get."""
    return events.select("id", F.col("effective_priority").alias("priority"), "topic", "body", F.length("body").cast("long").alias("body_len"))


def matching(events: DataFrame, prefix: str | None) -> DataFrame:
    """Events whose topic begins with prefix; all without one. The filter reaches a Parquet scan."""
    return events.where(F.startswith(F.col("topic"), F.lit(prefix))) if prefix else events


def fan_out(events: DataFrame, subscribers: dict[str, str]) -> DataFrame:
    """(subscriber, ...): each event once for each of the subscribers (name: prefix) that it matches, without a join."""
    taking = F.array(*(F.when(F.startswith(F.col("topic"), F.lit(p)), F.lit(n)) for n, p in sorted(subscribers.items())))
    return events.select(F.explode(F.array_compact(taking)).alias("subscriber"), "*")


class Subscriptions:
    """Callbacks by prefix, for batches of a stream. One that returns something other than 0 or None is dropped.

    A callback gets a DataFrame; what it raises is kept in `errors` and doesn't stop the others.
    """

    def __init__(self) -> None:
        self.active: list[tuple[str | None, Callable[[DataFrame], int | None]]] = []
        self.dropped: list[Callable[[DataFrame], int | None]] = []
        self.errors: list[Exception] = []
        self.enabled = True

    def subscribe(self, prefix: str | None, callback: Callable[[DataFrame], int | None]) -> None:
        self.active.append((prefix, callback))

    def subscribe_dropped(self, callback: Callable[[DataFrame], int | None]) -> None:
        """callback gets the dead letters of each batch: (id, topic, lane, processor, reason, drop_seq)."""
        self.dropped.append(callback)

    def clear(self) -> None:
        self.active.clear()
        self.dropped.clear()

    def notify_dropped(self, letters: DataFrame) -> None:
        """Tells observers of drops; they leave and fail as others do."""
        if not self.enabled:
            return
        kept = []
        for callback in self.dropped:
            try:
                if callback(letters) in (0, None):
                    kept.append(callback)
            except Exception as e:  # noqa: BLE001  an observer must not stop the stream
                self.errors.append(e)
                kept.append(callback)
        self.dropped = kept

    def notify(self, events: DataFrame) -> None:
        if not self.enabled:
            return
        kept = []
        for prefix, callback in self.active:
            try:
                if callback(external(matching(events, prefix))) in (0, None):
                    kept.append((prefix, callback))
            except Exception as e:  # noqa: BLE001  a subscriber must not stop the stream
                self.errors.append(e)
                kept.append((prefix, callback))
        self.active = kept
