"""Bucketed layers, incremental refresh and the model table."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SMALL
from tillcast.operators import anomaly, solve
from tillcast.plans.registry import Views
from tillcast.session import bucketed
from tillcast.sources import refresh as R, tables

KEYS = ["store", "dept"]


def month():
    return F.date_format("date", "yyyy-MM")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_on_a_bucketed_layer_need_no_exchange(spark):
    sales = bucketed(Views(spark, SMALL).sales, KEYS, "date", 4)
    p = plan(anomaly.rolling_zscore(sales))
    assert "Window" in p and "Exchange" not in p
    p = plan(E.queries()["store_features_layer"](spark, SMALL))
    assert all("Exchange" not in below for below in p.split("Window")[1:2]) and "Bucketed: true" in p
    windows = [line for line in p.split("\n") if "Window" in line or "Exchange hashpartitioning(store" in line]
    assert windows and not any("Exchange" in line for line in windows)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def layer(spark, path):
    return sorted(tuple(str(v) for v in r) for r in spark.read.parquet(path).drop(R.PART).collect())


@pytest.fixture()
def sales(spark):
    day = dt.date(2020, 1, 3)
    rows = [(s, d, day + dt.timedelta(weeks=k), float((s * 31 + d * 17 + k * k * 7) % 101)) for s in (1, 2) for d in (1, 2) for k in range(60)]
    return spark.createDataFrame(rows, "store int, dept int, date date, weekly_sales double")


@pytest.mark.parametrize("changed", ["date > '2021-02-10'", "store = 1 and date = '2020-06-05'", "store = 2 and dept = 1 and date in ('2020-03-06', '2020-05-01')",
                                     "false", "date < '2020-02-01'"])
def test_refresh_equals_a_full_run_and_leaves_the_rest_alone(spark, sales, changed):
    out = tempfile.mkdtemp(prefix="tillcast-refresh-", dir="/tmp")
    R.write_parts(anomaly.rolling_zscore(sales), f"{out}/full", month())
    old = sales.withColumn("weekly_sales", F.when(F.expr(changed), F.col("weekly_sales") * 3).otherwise(F.col("weekly_sales")))
    R.write_parts(anomaly.rolling_zscore(old), f"{out}/layer", month())
    before = files(f"{out}/layer")
    parts = R.refresh(sales, sales.where(changed).select(*KEYS, "date"), f"{out}/layer", anomaly.rolling_zscore, month(), KEYS, back=7, on=7)
    assert layer(spark, f"{out}/layer") == layer(spark, f"{out}/full")
    after = files(f"{out}/layer")
    same = {f for f, t in before.items() if after.get(f) == t}
    touched = {f.split("part=")[1].split("/")[0] for f in set(before) - same}
    assert touched == set(parts)
    want = {r[0] for r in sales.where(changed).select(month()).collect()}
    assert want <= set(parts) and len(parts) <= len({f.split("part=")[1].split("/")[0] for f in before})
    assert changed == "date < '2020-02-01'" or len(same) >= 5


def test_new_rows_and_late_rows(spark, sales):
    out = tempfile.mkdtemp(prefix="tillcast-refresh-", dir="/tmp")
    new = (F.col("date") > "2021-01-15") | ((F.col("store") == 2) & (F.col("date") == "2020-04-10"))
    R.write_parts(anomaly.rolling_zscore(sales.where(~new)), f"{out}/layer", month())
    R.refresh(sales, sales.where(new).select(*KEYS, "date"), f"{out}/layer", anomaly.rolling_zscore, month(), KEYS, back=7, on=7)
    R.write_parts(anomaly.rolling_zscore(sales), f"{out}/full", month())
    assert layer(spark, f"{out}/layer") == layer(spark, f"{out}/full")


def test_saved_coefficients_give_the_same_forecasts(spark):
    from tillcast.plans.q_forecast import EXOG, _series, _with_markdown
    out = tempfile.mkdtemp(prefix="tillcast-models-", dir="/tmp")
    s, x = _series(spark, SMALL), _with_markdown(spark, SMALL)
    tables.write_models(solve.fourier_fit(s, log_target=True), out)
    tables.write_models(solve.arx_fit(x, exog=EXOG, log_target=True), out)

    def rows(df):
        return sorted(tuple(str(v) for v in r) for r in df.select("level", "store", "model", "date", "actual", "forecast").collect())
    back = tables.read_models(spark, out, "fourier_trend")
    assert "PartitionFilters: [isnotnull(model" in plan(back)
    assert rows(solve.fourier_score(s, back, log_target=True)) == rows(solve.fourier_trend(s, log_target=True))
    arx = tables.read_models(spark, out, "arx")
    want = rows(solve.arx_walk_forward(x, exog=EXOG, log_target=True))
    assert rows(solve.arx_score(x, arx, exog=EXOG, log_target=True)) == want and want
    one = tables.read_models(spark, out, "fourier_trend", "store", back.where("store is not null").first().store).collect()
    assert len(one) == 1 and len(one[0].coef) == 12 and one[0].params["log_target"] == "true"
