import pytest

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(parity, name):
    parity.check(queries.queries()[name], SQL[name])


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
