import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelane.functions import binary, histogram


def test_integers_in_bytes(spark):
    df = spark.createDataFrame([(bytes([1, 2, 3, 4]),), (bytes([255] * 4),), (b"\x01",), (b"",), (None,)], "b binary")
    got = df.select(
        binary.be_uint(F.col("b"), 1, 4).alias("be"), binary.le_uint(F.col("b"), 1, 4).alias("le"), binary.be_uint(F.col("b"), 1, 1).alias("u8")
    ).collect()
    assert [tuple(r) for r in got] == [(16909060, 67305985, 1), (2**32 - 1, 2**32 - 1, 255), (None, None, 1), (None, None, None), (None, None, None)]


def test_bytes_of_integers(spark):
    r = spark.range(1).select(binary.be_bytes(F.lit(258), 4).alias("be"), binary.le_bytes(F.lit(258), 4).alias("le")).first()
    assert bytes(r.be) == b"\x00\x00\x01\x02" and bytes(r.le) == b"\x02\x01\x00\x00"


def test_crc_equals_zlib(spark):
    data = [b"", b"a", bytes(range(256))]
    got = spark.createDataFrame([(d,) for d in data], "b binary").select(F.crc32("b").alias("c")).collect()
    assert [r.c for r in got] == [zlib.crc32(d) for d in data]


def test_highest_bit_is_exact(spark):
    values = [0, 1, 2, 3, 4, 1023, 1024, 2**50 - 1, 2**50, 2**63 - 1]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(binary.msb(F.col("v")).alias("m")).collect()
    assert [r.m for r in got] == [0, 0, 1, 1, 2, 9, 10, 49, 50, 62]


def test_percentile_of_one_sample(spark):
    h = histogram.log2_histogram(spark.createDataFrame([(9,)], "v long"), "v")
    assert [r.value for r in histogram.histogram_percentiles(h, [50]).collect()] == [12]


def test_empty_histogram(spark):
    h = histogram.log2_histogram(spark.createDataFrame([], "v long"), "v")
    assert [r.value for r in histogram.histogram_percentiles(h, [50.0, 99.0]).collect()] == [0, 0]
    assert tuple(histogram.histogram_bounds(h).first()) == (0, 0, 0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 2**62), min_size=1, max_size=60))
def test_percentiles_by_rule(spark, values):
    h = histogram.log2_histogram(spark.createDataFrame([(v,) for v in values], "v long"), "v")
    buckets = sorted(max(v.bit_length() - 1, 0) for v in values)
    for r in histogram.histogram_percentiles(h, [50, 99.9]).collect():
        b = buckets[min(int(r.p / 100 * len(values)), len(values) - 1)]
        assert r.value == (0 if b == 0 else 2**b + 2 ** (b - 1))
