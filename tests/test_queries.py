"""Every registered query at the smallest scale: against its SQL, and by its plan."""

import re

import oracle
import pytest

import __spark_entry__ as entry

NAMES = list(entry.queries())
# The text operators work on numpy in their tasks; everything else is made of expressions.
PYTHON_ALLOWED = re.compile(r"op\d+_|pipeline")


@pytest.fixture(scope="module")
def connection(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, folder, name):
    frame = entry.queries()[name](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if not PYTHON_ALLOWED.match(name):
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)
    assert oracle.compare(spark, connection, folder, name, frame) is None


def test_entry_runs(spark, folder):
    frame = entry.entry(spark)
    assert frame.columns == ["value", "n"]
    assert frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)
