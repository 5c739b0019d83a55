"""Every query with checking SQL gives the same rows as that SQL in an independent engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import connect, difference

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, small, duck, name):
    mine = entry.queries()[name](spark, small).toPandas()
    assert difference(mine, duck.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["flows_per_src"] >= rows[-1]["flows_per_src"]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())
