"""Every ready-made query against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import connect, rows_of
from strandlake.plans.oracles import ORACLES
from strandlake.plans.workloads import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    result = QUERIES[name](spark, sf)
    mine = rows_of(result.columns, [tuple(r) for r in result.collect()])
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        assert mine == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry(spark).columns == ["depth", "n"]
