"""Anomaly detection: rolling z-score, decomposition, consensus repair, LOF, isolation forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import written

SERIES = ["store", "dept"]


def rolling_zscore(df: DataFrame, value: str = "weekly_sales", keys: list[str] = SERIES,
                   order: str = "date", window: int = 8, threshold: float = 2.0,
                   eps: float = 1e-5) -> DataFrame:
    """z = (y - mean) / (std + eps) over the last ``window`` observed rows, current included.

    min_periods = 1, sample std; row 1 of a series has a null std, hence a null z and flag 0.
    One exchange on the series key, one sort, one Window operator.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    y = F.col(value)
    z = (y - F.avg(y).over(w)) / (F.stddev_samp(y).over(w) + F.lit(eps))
    return (df.withColumn("rolling_zscore", z)
              .withColumn("rolling_anomaly",
                          F.coalesce((F.abs("rolling_zscore") > threshold).cast("int"), F.lit(0))))


def flag_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """Percent of rows flagged by each detector, one row per detector."""
    aggs = [(F.avg(F.col(f).cast("double")) * 100.0).alias(f) for f in flags]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{f}', {f}" for f in flags)
    return wide.selectExpr(f"stack({len(flags)}, {stack}) as (detector, percent)")


def classical_decompose(df: DataFrame, value: str = "weekly_sales", keys: list[str] = SERIES,
                        order: str = "date", period: int = 52, threshold: float = 2.5,
                        prefix: str = "stk") -> DataFrame:
    """Additive moving-average decomposition per series, with a residual z flag.

    trend    = centred 2 x ``period`` moving average over observed rows (half
               weights at both ends), null where the window is not full;
    seasonal = mean detrended value per phase (row position mod period),
               centred over the phases;
    resid    = y - trend - seasonal; flag = |resid z| > ``threshold`` (sample std).
    Series with fewer than two periods get null parts and flag 0.

    All windows share the (keys) hash partitioning: the phase window
    partitions by (keys, phase), which the existing distribution satisfies, so
    the whole operator costs one exchange.
    """
    half = period // 2
    w = Window.partitionBy(*keys).orderBy(order)
    wall = Window.partitionBy(*keys)
    wphase = Window.partitionBy(*keys, "_phase")
    y = F.col(value)
    ok = F.col("_n") >= 2 * period
    out = (df.withColumn("_n", F.count(F.lit(1)).over(wall))
             .withColumn("_rn", F.row_number().over(w)))
    # The moving-average numerator is summed as an exact decimal (sales carry
    # cents), so the trend does not depend on the order of a floating sum.
    yd = y.cast("decimal(22,4)")
    inner = F.sum(yd).over(w.rowsBetween(-(half - 1), half - 1))
    lo, hi = F.lag(yd, half).over(w), F.lead(yd, half).over(w)
    numer = ((lo + hi) * F.lit(0.5).cast("decimal(2,1)") + inner).cast("double")
    out = (out.withColumn(f"{prefix}_trend",
                          F.when(ok & lo.isNotNull() & hi.isNotNull(), numer / F.lit(float(period))))
              .withColumn("_phase", (F.col("_rn") - 1) % period))
    detr = y - F.col(f"{prefix}_trend")
    out = (out.withColumn("_pm", F.avg(detr).over(wphase))
              .withColumn("_pw", F.col("_pm") / F.count(F.lit(1)).over(wphase)))
    out = out.withColumn(f"{prefix}_season",
                         F.when(ok, F.col("_pm") - F.sum("_pw").over(wall) / F.lit(float(period))))
    out = out.withColumn(f"{prefix}_resid", y - F.col(f"{prefix}_trend") - F.col(f"{prefix}_season"))
    r = F.col(f"{prefix}_resid")
    z = (r - F.avg(r).over(wall)) / F.stddev_samp(r).over(wall)
    out = out.withColumn(f"{prefix}_anomaly", F.coalesce((F.abs(z) > threshold).cast("int"), F.lit(0)))
    return out.drop("_n", "_rn", "_phase", "_pm", "_pw")


def seasonal_medians(df: DataFrame, value: str = "weekly_sales", by: list[str] | None = None,
                     approx: bool = False) -> DataFrame:
    """Median of ``value`` per week of year (or per ``by``): at most 53 rows by default."""
    by = by or ["week_of_year"]
    if approx:
        return df.groupBy(*by).agg(F.percentile_approx(value, 0.5, 100000).cast("double")
                                   .alias("seasonal_median"))
    # few, very large groups: exact medians without buffering a group in one task
    from tillcast.functions.quantiles import exact_group_quantiles
    return exact_group_quantiles(df, by, value, [0.5]).withColumnRenamed("q0", "seasonal_median")


def seasonal_median_fill(df: DataFrame, flag: str = "final_anomaly", value: str = "weekly_sales",
                         by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Replace flagged values by the seasonal median of their week (weekly_sales_cleaned).

    With the default key the median table has at most 53 rows (weeks of a year), so
    broadcasting it is bounded; with a finer ``by`` the optimizer picks the join.
    """
    by = by or ["week_of_year"]
    med = seasonal_medians(df, value, by, approx)
    if by == ["week_of_year"]:
        med = F.broadcast(med)
    out = df.join(med, by, "left")
    return out.withColumn(f"{value}_cleaned",
                          F.when(F.col(flag) == 1, F.col("seasonal_median")).otherwise(F.col(value))) \
              .drop("seasonal_median")


def clean_sales(prepared: DataFrame, decomposition: str = "moving_average") -> DataFrame:
    """Rolling z + decomposition flags, consensus flag, seasonal-median repair.

    ``decomposition='moving_average'`` (default, all windows, SQL-checkable) or
    ``'stl'`` (LOESS per series in a grouped pandas UDF, as the reference cleans).
    """
    out = rolling_zscore(prepared)
    if decomposition == "stl":
        from tillcast.operators.stl import stl_decompose
        parts = stl_decompose(prepared).select(
            "store", "dept", "date", F.col("stl_trend").alias("stk_trend"),
            F.col("stl_season").alias("stk_season"), F.col("stl_resid").alias("stk_resid"),
            F.col("stl_anomaly").alias("stk_anomaly"))
        out = out.join(parts, ["store", "dept", "date"], "left")
    else:
        out = classical_decompose(out)
    out = out.withColumn("final_anomaly",
                         ((F.col("stk_anomaly") == 1) & (F.col("rolling_anomaly") == 1)).cast("int"))
    # the median passes and the repaired output both read this store-dept-week table:
    # it is a layer of its own, written once
    return seasonal_median_fill(written(out))
