import pytest

from tidelane.plans import registry

from .conftest import DATA, oracle_rows, rows_of

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name not in SQL:
        assert df.count() > 0
        return
    names, want = oracle_rows(duck, SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
