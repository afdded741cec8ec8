import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config(
            "spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-")
        ).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        table, at = name.removesuffix(".parquet"), f"{DATA}/{name}"
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(df) -> list[tuple]:
    """Rows of a Spark DataFrame by column name, as sorted plain tuples."""
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def oracle_rows(duck, sql: str) -> tuple[list[str], list[tuple]]:
    c = duck.execute(sql)
    names = [d[0] for d in c.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in c.fetchall()), key=repr)
