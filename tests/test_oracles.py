"""Every query against its SQL twin on the smallest tables (compare.py runs larger ones)."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from sentika.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
# The training-data queries have tests of their own.
QUERIES, ORACLES = catalog.QUERIES, oracles.oracle_sql()
# Exercised in test_jobs.py on smaller settings.
SLOW = {"train_evaluate"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    problem = difference(QUERIES[name](spark, SF), con, ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 12
