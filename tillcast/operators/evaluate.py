"""Evaluation: metrics per (level, store, model), model ranking with null-safe keys,
winner tables, R^2 bands, chain totals, store comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.numeric import guarded_corr

LEVEL = ["level", "store"]


def forecast_metrics(fc: DataFrame, keys: list[str] = (*LEVEL, "model")) -> DataFrame:
    """RMSE and R^2 per group in one aggregate (SST = n * population variance)."""
    e2 = F.pow(F.col("actual") - F.col("forecast"), 2)
    sst = F.count("actual") * F.var_pop("actual")
    return fc.where(F.col("forecast").isNotNull()).groupBy(*keys).agg(
        F.sqrt(F.avg(e2)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(e2), F.when(sst != 0, sst))).alias("r2"),
        F.count(F.lit(1)).alias("n"))


def common_weeks(fc: DataFrame, n_models: int) -> DataFrame:
    """The rows of weeks that all ``n_models`` models forecast in a series, so that all are scored on the same ones."""
    known = fc.where(F.col("forecast").isNotNull())
    w = Window.partitionBy(*LEVEL, "date")
    return known.withColumn("_m", F.count(F.lit(1)).over(w)).where(F.col("_m") == n_models).drop("_m")


def rank_models(metrics: DataFrame) -> DataFrame:
    """Rank inside (level, store): R^2 desc, RMSE asc, model name; rank 1 is best."""
    w = Window.partitionBy(*LEVEL).orderBy(F.desc_nulls_last("r2"), F.asc_nulls_last("rmse"), "model")
    return metrics.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)


def results_with_best(metrics: DataFrame) -> DataFrame:
    """Every result row with its group's best model: one window, which holds null stores too."""
    r = rank_models(metrics)
    w = Window.partitionBy(*LEVEL).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return r.select("*", F.first("model").over(w).alias("best_model_name"), F.first("r2").over(w).alias("best_r2"),
                    F.first("rmse").over(w).alias("best_rmse"))


def best_by_store(metrics: DataFrame) -> DataFrame:
    """The model with the highest R^2 per store (store level only)."""
    return rank_models(metrics.where(F.col("level") == "store")).where("is_best").select(
        "store", "model", "r2", "rmse")


def r2_band(r2) -> F.Column:
    # Band labels of the reference error report.
    return (F.when(r2 >= 0.75, "Excellent (> 0.75)").when(r2 >= 0.5, " (0.5 to 0.75)")
            .when(r2 >= 0.25, "Decent (0.25 to 0.5)").when(r2 >= 0, "Weak Positive (0 to 0.5)")
            .when(r2 >= -1, "Reasonably Well (-1 to 0)").otherwise("Poor (< -1)"))


def r2_bands(best: DataFrame) -> DataFrame:
    return best.groupBy(r2_band(F.col("r2")).alias("r2_category")).agg(F.count(F.lit(1)).alias("n_stores"))


def r2_rmse_corr(metrics: DataFrame) -> DataFrame:
    return metrics.agg(guarded_corr("r2", "rmse").alias("r2_rmse_corr"))


def chain_actual_vs_pred(fc: DataFrame) -> DataFrame:
    """Per model and date: summed actual and forecast over the store-level rows."""
    return fc.where(F.col("level") == "store").groupBy("model", "date").agg(
        F.sum("actual").alias("actual"), F.sum("forecast").alias("predicted"))


def compare_stores(series: DataFrame, fc: DataFrame, metrics: DataFrame, stores: DataFrame,
                   chosen: list[int]) -> DataFrame:
    """History, best-model forecast, store type and best RMSE for the chosen stores."""
    best = rank_models(metrics).where("is_best").where(F.col("level") == "store") \
        .select("store", F.col("model").alias("best_model"), F.col("rmse").alias("best_rmse"))
    hist = series.where((F.col("level") == "store") & F.col("store").isin(chosen)).select(
        "store", "date", F.lit("history").alias("kind"), F.col("y").alias("value"))
    f = fc.where(F.col("level") == "store").join(best, "store").where(F.col("model") == F.col("best_model")) \
        .where(F.col("store").isin(chosen)).select("store", "date", F.lit("forecast").alias("kind"),
                                                   F.col("forecast").alias("value"))
    out = hist.unionByName(f).join(best, "store", "left").join(stores.select("store", "type"), "store", "left")
    return out
