"""Every registered query against its SQL on the whole tables."""

import compare
import pytest

from threatlake.plans import catalogue

ORACLES = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    found = compare.difference(connection, spark, QUERIES[name], ORACLES[name], sf_dir)
    assert found is None, found


def test_every_query_has_sql():
    # A forest's importances are not for SQL to state; test_learning has what must hold of them.
    assert set(QUERIES) - set(ORACLES) == {"ml_topfeat"}
    assert set(ORACLES) <= set(QUERIES)
