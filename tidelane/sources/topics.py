"""Topic files: lines of topic:PRIORITY."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators.model import Priority, values_of


def parse_topics(lines: DataFrame, value: str = "value", order: str = "line") -> DataFrame:
    """(topic, priority) from lines (order, value).

    What follows # is a comment; the first colon ends the topic; both parts lose blanks around them. Lines without a
    colon or with an unknown priority are skipped, and a topic's last line counts.
    """
    clean = F.regexp_replace(value, "#.*", "")
    at = F.instr(clean, ":")
    trim = lambda c: F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    x = lines.select(
        F.col(order).alias("o"), F.when(at > 0, trim(F.substr(clean, F.lit(1), at - 1))).alias("topic"),
        values_of(Priority, trim(F.substr(clean, at + 1))).alias("priority")
    )
    return x.where("topic is not null and priority is not null").groupBy("topic").agg(F.max_by("priority", "o").alias("priority"))


def merge_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after a reload: new rows replace old ones of the same topic, and none go."""
    both = old.select("topic", "priority", F.lit(0).alias("o")).unionByName(new.select("topic", "priority", F.lit(1).alias("o")))
    return both.groupBy("topic").agg(F.max_by("priority", "o").alias("priority"))
