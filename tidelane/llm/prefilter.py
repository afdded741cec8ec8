"""A filter of bounded size that drops most rows that a later exact join would not match, and a join by ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 20, 27  # bits are a power of two: an eighth of a megabyte to sixteen
_PART = 32768  # bits that one value of bitmap_construct_agg holds
FEW = 200_000


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A byte array with a bit set for each value of a one-column table of well-mixed longs.

    It takes sixteen bits a row between the bounds, so it stays small whatever the input; a fuller one only
    lets more rows pass to the join that follows.
    """
    power = min(MOST, max(LEAST, (16 * max(hashes.count(), 1) - 1).bit_length()))
    place = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << power) - 1)) + 1  # bitmap functions number bits from 1
    parts = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    ).collect()
    out = np.zeros((1 << power) // 8, dtype=np.uint8)
    for r in parts:
        out[(r.b - 1) * _PART // 8 : r.b * _PART // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the bitmap; for the others it is sure that they aren't."""
    p = hashes & np.int64(len(bits) * 8 - 1)
    return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def restricted(rows: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose key is in the one-column table ids, which is written already; with left_anti, all others.

    FEW ids or fewer are broadcast, eight bytes each, so that whole texts needn't be shuffled; more are joined.
    """
    few = ids.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(ids) if few else ids, rows[key] == ids[ids.columns[0]], how)
