"""Every registered query with a twin gives the twin's rows on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names():
    assert set(TWINS) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    n, problem = compare(spark, con, SF, name, entry.queries()[name], TWINS[name])
    assert not problem, problem


@pytest.mark.parametrize("name", ["m07_scored_rows", "m14_ood_gate_run", "m18_permutation_importance", "e15_decide_flow"])
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
