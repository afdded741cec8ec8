"""The commonest rows of a table of counts, without sorting it or sending a part of each task to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commonest(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the highest counts: as many whole steps of an eighth of an octave as hold `most` rows or fewer."""
    step = F.floor(F.log2(F.col(column).cast("double")) * 8)
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):
        held += r["count"]
        if held > most:
            break
        least = r.s
    return counts.where(step >= least) if least is not None else counts.limit(0)
