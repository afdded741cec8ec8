"""Numbers in binary columns, and binary columns of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_uint(data: Column, at: int | Column, size: int) -> Column:
    """Big-endian unsigned integer of `size` bytes from byte `at` (from 1); null where data ends before."""
    part = F.substring(data, at, size) if isinstance(at, int) else F.substr(data, at, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def le_uint(data: Column, at: int, size: int) -> Column:
    """Little-endian unsigned integer of `size` bytes from byte `at` (from 1); null where data ends before."""
    digits = F.concat(*(F.hex(F.substring(data, at + size - 1 - k, 1)) for k in range(size)))
    return F.when(F.length(data) >= at + size - 1, F.conv(digits, 16, 10).cast("long"))


def be_bytes(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def le_bytes(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * (size - 1 - k) + 1, 2) for k in range(size))))


def msb(value: Column) -> Column:
    """Place of the highest set bit of a positive long; 0 for 0. Exact, which floor(log2(x)) isn't."""
    return F.greatest(F.length(F.bin(value)) - 1, F.lit(0))
