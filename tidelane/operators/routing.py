"""Topic priorities, effective priority, lanes, and the pressure that diverts HIGH events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import BATCH, REALTIME, TRANSACTIONAL, Priority


def with_table_priority(events: DataFrame, topics: DataFrame, bound: int = 100_000) -> DataFrame:
    """events with table_priority, null for topics that topics (topic, priority) doesn't list.

    The table is broadcast if it has `bound` rows or fewer, which is looked up once for each table.
    """
    t = topics.select("topic", F.col("priority").cast("int").alias("table_priority"))
    if not hasattr(topics, "_few"):
        topics._few = topics.limit(bound + 1).count() <= bound
    return events.join(F.broadcast(t) if topics._few else t, "topic", "left")


def effective(client: Column, table: Column) -> Column:
    """The higher of the client's priority and the table's, MEDIUM where the table has none."""
    return F.greatest(client, F.coalesce(table, F.lit(int(Priority.MEDIUM))))


def lane(priority: Column) -> Column:
    return F.when(priority >= int(Priority.HIGH), REALTIME).when(priority >= int(Priority.LOW), TRANSACTIONAL).otherwise(BATCH)


def route(events: DataFrame, topics: DataFrame) -> DataFrame:
    """events with effective_priority and lane."""
    x = with_table_priority(events, topics).withColumn("effective_priority", effective(F.col("priority"), F.col("table_priority")))
    return x.drop("table_priority").withColumn("lane", lane(F.col("effective_priority")))


def pressure_latch(routed: DataFrame, high: int = 12_000, critical: int = 14_000, part_rows: int = 50_000) -> DataFrame:
    """routed with rank, pressure and lane_after, for a burst that nothing consumes.

    rank numbers the events of priority HIGH and CRITICAL by id. Pressure is taken before an event is put into
    the realtime lane, and only then; once it has reached HIGH every HIGH event goes to the transactional lane.
    The count is taken within ranges of id and offset by the ranges before, so no task sees all events.
    """
    urgent = (F.col("effective_priority") >= int(Priority.HIGH)).cast("long")
    ends = routed.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).first()
    parts = min(100_000, max(64, ends.n // part_rows))
    width = max(1, ((ends.high or 0) - (ends.low or 0)) // parts + 1)
    x = routed.withColumns({"urgent": urgent, "part": F.floor((F.col("id") - F.lit(ends.low or 0)) / width)})
    sums = x.groupBy("part").agg(F.sum("urgent").alias("s"))
    offsets = sums.select(
        "part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    )
    within = F.sum("urgent").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("within", within).join(F.broadcast(offsets), "part")
    rank = F.when(F.col("urgent") == 1, F.col("offset") + F.col("within"))
    level = F.when(rank - 1 >= critical, 2).when(rank - 1 >= high, 1).otherwise(0)
    diverted = (F.col("effective_priority") == int(Priority.HIGH)) & (rank > high + 1)
    return x.withColumns({
        "rank": rank, "pressure": F.when(rank.isNotNull(), level), "lane_after": F.when(diverted, TRANSACTIONAL).otherwise(F.col("lane"))
    }).drop("urgent", "part", "within", "offset")
