"""Round trips through the parquet layers and the raw CSV reader."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SMALL
from tillcast.plans.registry import Views
from tillcast.sources import tables


def test_layer_round_trip_with_partition_pruning(spark):
    out = tempfile.mkdtemp(prefix="tillcast-layer-", dir="/tmp")
    prep = Views(spark, SMALL).prepared
    tables.write_layer(prep, f"{out}/prepared", partition_by=["store"])
    back = tables.read_layer(spark, f"{out}/prepared")
    assert back.count() == prep.count()
    one = back.where(F.col("store") == 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(store" in plan
    assert one.count() == prep.where(F.col("store") == 1).count()


def test_results_and_rules_written(spark):
    out = tempfile.mkdtemp(prefix="tillcast-results-", dir="/tmp")
    fc = E.queries()["naive_tail"](spark, SMALL)
    m = E.queries()["forecast_metrics"](spark, SMALL)
    tables.write_forecasts(fc, m, out)
    assert os.path.isdir(f"{out}/forecasts/model=naive_tail")
    assert spark.read.parquet(f"{out}/metrics").count() == m.count()
    rules = E.queries()["association_rules"](spark, SMALL)
    tables.write_rules(rules, f"{out}/rules")
    assert spark.read.parquet(f"{out}/rules").count() == rules.count()


def test_raw_csv_reader_parses_text_dates(spark):
    out = tempfile.mkdtemp(prefix="tillcast-raw-", dir="/tmp")
    with open(f"{out}/sales.csv", "w") as f:
        f.write("Store,Dept,Date,Weekly_Sales,IsHoliday\n1,1,05/02/2010,24924.5,FALSE\n1,1,31/12/2010,100.0,TRUE\n")
    df = tables.read_raw_csv(spark, f"{out}/sales.csv", tables.RAW_SALES)
    rows = sorted(df.collect(), key=lambda r: r.date)
    assert [str(r.date) for r in rows] == ["2010-02-05", "2010-12-31"]
    assert rows[0].weekly_sales == 24924.5 and rows[1].is_holiday is True


def test_chain_totals_best_models_and_a_saved_pipeline(spark):
    out = tempfile.mkdtemp(prefix="tillcast-results-", dir="/tmp")
    q = E.queries()
    tables.write_chain_totals(q["chain_train_totals"](spark, SMALL), q["chain_actual_vs_pred"](spark, SMALL), out)
    assert spark.read.parquet(f"{out}/chain_train").count() > 0 and os.path.isdir(f"{out}/chain_forecast")
    ranked = q["rank_models"](spark, SMALL)
    tables.write_best_models(ranked, out)
    assert spark.read.parquet(f"{out}/best_models").count() == ranked.where("is_best").count()
    from tillcast.operators.trees import fit_predict_gbt
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(40)], "x double, y double")
    made = fit_predict_gbt(df, df, ["x"], "y", max_iter=2, save_to=f"{out}/gbt")
    again = tables.load_pipeline(f"{out}/gbt").transform(df)
    assert [r.forecast for r in made.orderBy("x").collect()] == [r.prediction for r in again.orderBy("x").collect()]
