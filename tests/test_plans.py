"""Physical-plan properties of the main queries."""

import __spark_entry__ as E
from tests.conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_has_no_cartesian_or_python(spark):
    p = _plan(E.entry(spark))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_prunes_columns(spark):
    df = E.queries()["rolling_zscore"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # lineitem is read with only the columns the view needs
    assert "l_comment" not in plan and "l_tax" not in plan


def test_store_filter_reaches_scan(spark):
    # the store filter passes the weekly aggregate and the joins into the supplier scan
    df = E.queries()["store_dept_trend"](spark, SMALL)
    assert "EqualTo(s_nationkey,1)" in _plan(df)


def test_no_cross_join_or_row_udf_in_any_checked_query(spark):
    bad = {}
    # these two run the jobs of their tuning, for half a minute each, before there is a plan
    for key in sorted(set(E.oracle_sql()) - {"tuning_rungs", "ranked_weeks"}):
        p = _plan(E.queries()[key](spark, SMALL))
        hits = [t for t in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if t in p]
        if hits:
            bad[key] = hits
    assert bad == {}


def test_inputs_are_planned_once(spark):
    # prepared sales and store weeks are layers that the rest of a plan reads
    for key, most in (("group_mean_ratios", 4), ("results_with_best", 6)):
        assert _plan(E.queries()[key](spark, SMALL)).count("FileScan") <= most, key
