"""Every query of the checks against its SQL oracle, and its plan.

No plan may form all pairs of rows or leave the JVM.  Queries that others register are tested where they are made.
"""

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import compare, oracle_connection


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroups")


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    def no_pairs_and_no_python(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for bad in FORBIDDEN:
            assert bad not in plan

    _, problem, _ = compare(
        spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir,
        no_pairs_and_no_python)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
