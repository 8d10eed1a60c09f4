import pytest

import __spark_entry__ as entry
from factlens.plans import comparison
from factlens.plans.queries import QUERIES

SQL = comparison.texts()


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) >= 75


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(same, name):
    same(QUERIES[name], SQL[name])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r.callers >= 0 for r in rows)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
