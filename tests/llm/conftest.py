import pytest

from tidelane.llm.scratch import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


#: Rows that try every operator on documents: nulls, blanks, a very long word, repeated rows, ties.
ODD = [
    (
        1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega", "en", "a", 1
    ), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \t\n\x0b ", "", "", 0), (5, "x" * 50_000, "de", "a", 9),
    (6, "same text here", "en", "b", 1), (6, "same text here", "en", "b", 1), (7, "Same TEXT\nhere", "en", None, 1), (None, "no id at all", "en", "a", 1), (
        8, "é ß 日本 \U0001f600 <|endoftext|>", "fr", "c", 1
    ),
    (9, "one", "en", "c", 1), (10, "line\nline\nline\n\nother", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    for clash in ("id", "key", "n", "size", "component", "row", "a", "b", "score", "ids", "kept", "rows", "__id"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
