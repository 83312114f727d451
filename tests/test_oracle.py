"""Every catalogue query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from chromloom.catalog.registry import ORACLES, QUERIES
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: Queries that rightly return no row on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert problem is None or problem == "EMPTY" and name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).columns == ["cond", "n_points", "exponent", "log_intercept"]


def test_no_reserved_names():
    for name in QUERIES:
        assert "pipeline" not in name and not name.startswith("op")
