import pytest

from palimpsest.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(parity, name):
    parity.check(catalog.queries()[name], SQL[name])


def test_all_queries_have_sql():
    assert set(catalog.queries()) == set(SQL)


def test_entry_is_live_view(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["k", "seq", "v"] and df.count() > 0
