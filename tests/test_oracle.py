"""Every registered query against its SQL, or at least against emptiness."""

import os

import pytest
from compare import connect, difference

from tallyveer.registry import load

QUERIES, ORACLES = load()
FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == [
        "rank", "dimension", "group_value", "delta", "contribution_pct"
    ]
