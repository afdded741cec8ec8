"""Dead letters: every dropped event with its reason, bounded views, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RING = 1000


def dead_letters(told: DataFrame) -> DataFrame:
    """(id, topic, lane, processor, reason, drop_seq) of lanes.fates(): drop_seq orders drops by arrival, then id."""
    return told.where(F.col("letter").isNotNull()).select(
        "id", "topic", "lane", "processor", F.col("letter").alias("reason"), F.col("arrival_us").alias("drop_seq")
    )


def newest(letters: DataFrame, most: int = RING) -> DataFrame:
    """The last `most` drops, as the bounded store holds them; planned as a top-k."""
    return letters.orderBy(F.desc("drop_seq"), F.desc("id")).limit(most)


def recent(letters: DataFrame, most: int = 100, ring: int = RING) -> DataFrame:
    """The last drops that the bounded store holds, newest first."""
    return newest(letters, min(most, ring))


def statistics(letters: DataFrame, ring: int = RING) -> DataFrame:
    """(total, stored, last_reason, last_seq); one row. total isn't bounded, stored is."""
    total = F.count(F.lit(1))
    return letters.agg(
        total.alias("total"), F.least(total, F.lit(ring)).alias("stored"), F.max_by("reason", F.struct("drop_seq", "id")).alias("last_reason"),
        F.max("drop_seq").alias("last_seq")
    )


def text_line(letters: DataFrame) -> DataFrame:
    """One text line a drop, for a text sink."""
    line = F.format_string("[%d] DROPPED: id=%d topic=%s lane=%s reason=%s", F.floor(F.col("drop_seq") / 1_000_000), "id", "topic", "lane", "reason")
    return letters.select(line.alias("value"))


