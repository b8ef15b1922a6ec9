"""Calls are dealt to tasks of bounded size, with the same results."""

import re

import pytest

from cohortspark import cohort
from cohortspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ("sample_burden", "burden", "carrier_runs", "carrier_report", "permuted_calpha", "rvt1_p")


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", NAMES)
def test_tasks_hold_so_many_rows(spark, monkeypatch, name):
    """More calls make more tasks at every exchange that calls pass: Spark merges none of these."""
    want = rows(QUERIES[name](spark, SF))
    monkeypatch.setattr(cohort, "TASK_ROWS", 500)
    df = QUERIES[name](spark, SF)
    assert rows(df) == want
    if name != "rvt1_p":  # its columns are written in between
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"(?:sample_id|variant_id)#\d+L?, 1[0-9]\), REPARTITION_BY_NUM", plan)) >= 2


def test_labels_travel_by_sample(spark):
    """A permutation is no row of its own on the way to a variant."""
    plan = QUERIES["permuted_calpha"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(variant_id#\d+L?, perm_id", plan)


def test_few_rows_are_left_to_spark():
    assert cohort.task_count(8 * cohort.TASK_ROWS, 8) == 0 and cohort.task_count(8 * cohort.TASK_ROWS + 1, 8) == 9
