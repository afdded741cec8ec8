"""Logarithmic histograms, and percentiles by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binary import msb


def log2_histogram(df: DataFrame, value: str) -> DataFrame:
    """(bucket, cnt): bucket is the highest set bit; 0 and 1 share bucket 0. Null values don't count."""
    return df.where(F.col(value).isNotNull()).groupBy(msb(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def bucket_value(bucket: Column) -> Column:
    """The middle of a bucket; 0 for bucket 0."""
    one = F.lit(1).cast("long")
    return F.when(bucket == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", one, bucket) + F.call_function("shiftleft", one, bucket - 1)
    )


def histogram_percentiles(hist: DataFrame, percents: list[float]) -> DataFrame:
    """(p, value) for each percentage: the first bucket whose running count is over floor(p / 100 * n), at most n - 1.

    A histogram without counts gives 0 for each. There are 64 buckets at most, so one task orders them.
    """
    order = Window.orderBy("bucket")
    run = hist.withColumns({"cum": F.sum("cnt").over(order), "n": F.sum("cnt").over(Window.partitionBy(F.lit(1)))})
    wanted = hist.sparkSession.createDataFrame([(float(p),) for p in percents], "p double")
    rank = F.least(F.floor(F.col("p") / 100 * F.col("n")), F.col("n") - 1)
    found = wanted.join(F.broadcast(run), F.col("cum") > rank, "left").groupBy("p").agg(F.min("bucket").alias("bucket"))
    return found.select("p", F.coalesce(bucket_value(F.col("bucket")), F.lit(0)).cast("long").alias("value"))


def histogram_bounds(hist: DataFrame) -> DataFrame:
    """(min_value, max_value, total): the least of the lowest bucket, the most of the highest; one row."""
    one = F.lit(1).cast("long")
    low, high = F.min("bucket"), F.max("bucket")
    least = F.when(low > 0, F.call_function("shiftleft", one, low)).otherwise(F.lit(0).cast("long"))
    return hist.agg(
        F.coalesce(least, F.lit(0)).alias("min_value"),
        F.coalesce(F.call_function("shiftleft", one, high + 1) - 1, F.lit(0)).cast("long").alias("max_value"),
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total")
    )


def exact_percentiles(df: DataFrame, value: str, percents: list[int], by: str) -> DataFrame:
    """(by, p, value): within each group the value at place floor(n * p / 100), from 0, in rising order; values are longs from 0.

    A first pass counts values by their highest eleven bits; only those that share these with a wanted place are
    then ordered, so no task meets a whole group.
    """
    x = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("long").alias("value"))
    x = x.withColumn(
        "step", msb(F.col("value")) * 2048 + F.call_function("shiftright", F.col("value"), F.greatest(msb(F.col("value")) - 10, F.lit(0)).cast("int"))
    )
    counts = x.groupBy(by, "step").agg(F.count(F.lit(1)).alias("c"))
    run = counts.withColumns({"cum": F.sum("c").over(Window.partitionBy(by).orderBy("step")), "n": F.sum("c").over(Window.partitionBy(by))})
    places = run.withColumn("p", F.explode(F.array(*(F.lit(p) for p in percents)))).withColumn(
        "place", F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1)
    )
    wanted = places.where((F.col("cum") > F.col("place")) & (F.col("cum") - F.col("c") <= F.col("place"))).select(
        F.col(by).alias("w_by"), F.col("step").alias("w_step"), "p", (F.col("place") - F.col("cum") + F.col("c")).alias("inner")
    )
    steps = wanted.select("w_by", "w_step").distinct()  # as many as there are groups and percents, at most
    inside = x.join(
        F.broadcast(steps), F.col(by).eqNullSafe(F.col("w_by")) & (F.col("step") == F.col("w_step"))
    ).groupBy(by, "step", "value").agg(F.count(F.lit(1)).alias("c"))
    inside = inside.withColumn("cum", F.sum("c").over(Window.partitionBy(by, "step").orderBy("value")))
    found = inside.join(F.broadcast(wanted), F.col(by).eqNullSafe(F.col("w_by")) & (F.col("step") == F.col("w_step")))
    return found.where((F.col("cum") > F.col("inner")) & (F.col("cum") - F.col("c") <= F.col("inner"))).select(by, "p", "value")
