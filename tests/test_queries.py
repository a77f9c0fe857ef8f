"""Every registered query against its SQL twin at the smallest scale."""

import pytest

from episodium.plans import catalogue
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, con, folder, name):
    problem, rows, _, _ = compare(
        spark, con, folder, catalogue.QUERIES[name], catalogue.ORACLES.get(name)
    )
    assert problem is None
    assert rows > 0


def test_every_query_has_sql():
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["partition", "task"]
    assert catalogue.QUERIES.keys() <= entry.queries().keys()
    assert catalogue.ORACLES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()
