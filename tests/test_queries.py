"""Every registered query of the engine against its SQL."""

import pytest

from marlstone import queries as Q
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(Q.QUERIES[name](spark, sf_dir), con, Q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).columns == ["query_id", "path", "score", "rank"]
    assert set(E.oracle_sql()) <= set(E.queries())
