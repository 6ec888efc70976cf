"""Every registered query against its SQL twin, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from loglore.plans.oracles import ORACLES
from loglore.plans.queries import QUERIES
from tests.oracle import normal, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    found = contract.queries()[name](spark, SF_DIR)
    names, rows = spark_rows(found)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    sql_names, expected = sql_rows(contract.oracle_sql()[name], SF_DIR)
    assert sorted(names) == sorted(sql_names)
    assert normal(names, rows) == normal(sql_names, expected)


def test_entry_has_rows(spark):
    found = contract.entry(spark)
    assert found.columns == ["query_id", "line_no", "sha", "similarity", "display"]
    assert found.head(1)
