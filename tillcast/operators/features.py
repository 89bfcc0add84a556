"""Feature engineering: group means and ratios, lags and shifted rolling windows,
scaling and encodings, calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.dates import iso_week
from tillcast.functions.numeric import TWO_PI, guarded_log1p, safe_div

SERIES = ["store", "dept"]


def store_dept_week(df: DataFrame, value: str = "weekly_sales_cleaned") -> DataFrame:
    """Sum of sales and mean of the drivers per (store, dept, date), plus calendar parts."""
    out = df.groupBy("store", "dept", "date").agg(
        F.sum(value).alias("weekly_sales"), F.avg("is_holiday").alias("is_holiday"),
        F.avg("fuel_price").alias("fuel_price"), F.avg("cpi").alias("cpi"),
        F.avg("unemployment").alias("unemployment"), F.avg("size").alias("size"))
    return out.select("*", iso_week("date").alias("weekofyear"),
                      F.month("date").cast("int").alias("month"), F.year("date").cast("int").alias("year"))


def calendar_features(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Year, month, ISO week, weekday (Mon = 0), year start/end, days since series start."""
    d = F.col(date)
    return df.select(
        "*", F.year(d).cast("int").alias("year"), F.month(d).cast("int").alias("month"),
        iso_week(d).alias("week_of_year"), (F.weekday(d)).cast("int").alias("day_of_week"),
        (F.dayofyear(d) == 1).alias("is_year_start"),
        ((F.month(d) == 12) & (F.dayofmonth(d) == 31)).alias("is_year_end"),
        F.datediff(d, F.min(d).over(Window.partitionBy(*keys))).cast("int").alias("days_since_start"))


def group_mean_ratios(df: DataFrame, value: str = "weekly_sales") -> DataFrame:
    """Means by store, dept and (store, dept) on every row; sales relative to them.

    Grouped aggregates (map-side partial sums, so a hot store costs nothing extra)
    joined back on their keys, instead of unordered windows that would pull
    every row of a store into one task.
    """
    y = F.col(value)
    # one pass over the rows; store and department means are rolled up from its sums
    cell = df.groupBy("store", "dept").agg(F.sum(y).alias("_s"), F.count(y).alias("_c"))
    mean = F.try_divide(F.sum("_s"), F.sum("_c"))
    means = (cell.join(cell.groupBy("store").agg(mean.alias("store_mean")), "store")
             .join(cell.groupBy("dept").agg(mean.alias("dept_mean")), "dept")
             .select("store", "dept", "store_mean", "dept_mean", F.try_divide("_s", "_c").alias("store_dept_mean")))
    out = df.join(means, ["store", "dept"], "left")
    return (out.withColumn("sales_vs_store", safe_div(y, "store_mean"))
               .withColumn("sales_vs_dept", safe_div(y, "dept_mean")))


def frequency_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row count of each value of each column, attached to every row."""
    cell = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))  # one pass; each column is rolled up from it
    out = df
    for c in cols:
        out = out.join(cell.groupBy(c).agg(F.sum("_n").alias(f"{c}_id_freq")), c, "left")
    return out


def cyclic_encode(df: DataFrame, base_year: int = 2010) -> DataFrame:
    return df.select(
        "*", (F.col("year") - base_year).alias("year_scaled"),
        F.sin(F.lit(TWO_PI) * F.col("month") / F.lit(12.0)).alias("month_sin_scaled"),
        F.cos(F.lit(TWO_PI) * F.col("month") / F.lit(12.0)).alias("month_cos_scaled"),
        F.cos(F.lit(TWO_PI) * F.col("week_of_year") / F.lit(52.0)).alias("weekofyear_scaled"))


def lags(df: DataFrame, value: str, ks: list[int], keys: list[str] = SERIES,
         order: str = "date", prefix: str = "lag") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", *[F.lag(value, k).over(w).alias(f"{prefix}_{k}") for k in ks])


def shifted_rolling(df: DataFrame, value: str, windows: list[int], keys: list[str] = SERIES,
                    order: str = "date", stat: str = "mean", full: bool = False,
                    prefix: str = "rolling") -> DataFrame:
    """Statistic over the ``w`` rows before the current one (no leakage), per series.

    ``full=False`` is min_periods = 1; ``full=True`` needs all ``w`` rows.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cols = []
    for n in windows:
        fr = w.rowsBetween(-n, -1)
        agg = F.avg(value) if stat == "mean" else F.stddev_samp(value)
        c = agg.over(fr)
        if full:
            c = F.when(F.count(value).over(fr) == n, c)
        cols.append(c.alias(f"{prefix}_{n}" if stat == "mean" else f"{prefix}_std_{n}"))
    return df.select("*", *cols)


def category_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Dense 0-based codes in sorted value order (pandas category codes).

    Codes come from the distinct values only (a small table), joined back.
    """
    out = df
    for c in cols:
        codes = df.select(c).distinct().select(
            c, (F.dense_rank().over(Window.orderBy(c)) - 1).cast("int").alias(f"{c}_code"))
        out = out.join(codes, c, "left")
    return out


def fit_robust(df: DataFrame, cols: list[str], approx: bool = False,
               accuracy: int = 100000) -> dict[str, tuple[float, float]]:
    """Median and IQR of each column: {col: (median, scale)}.

    Exact quartiles by a two-pass bracket (see functions.quantiles): no task ever
    holds a whole column. ``approx=True`` stops after the sketch pass. A zero
    (or undefined) IQR scales by 1, as the reference scaler does.
    """
    from tillcast.functions.quantiles import exact_quantiles
    qs = [0.25, 0.5, 0.75]
    if approx:
        row = df.agg(*[F.percentile_approx(c, qs, accuracy).alias(c) for c in cols]).first()
        quant = {c: row[c] for c in cols}
    else:
        cached = df.is_cached
        src = df if cached else df.select(*cols).persist()
        quant = exact_quantiles(src, cols, qs, accuracy)
        if not cached:
            src.unpersist()
    params = {}
    for c in cols:
        q = quant[c]
        q1, med, q3 = (0.0, 0.0, 0.0) if q is None or q[0] is None else [float(v) for v in q]
        iqr = q3 - q1
        params[c] = (med, iqr if iqr != 0 else 1.0)
    return params


def robust_scale(df: DataFrame, cols: list[str], suffix: str = "_scaled",
                 approx: bool = False) -> DataFrame:
    """(x - median) / IQR per column; parameters are a handful of driver scalars."""
    params = fit_robust(df, cols, approx)
    return df.select("*", *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"{c}{suffix}")
                            for c, (m, s) in params.items()])


SKEWED = ["weekly_sales", "sales_vs_store", "markdown1", "markdown2", "markdown3", "markdown4",
          "markdown5", "total_markdown"]
UNSKEWED = ["temperature", "fuel_price", "cpi", "unemployment", "size", "sales_vs_dept", "week_of_year"]


def log_transform(df: DataFrame, cols: list[str] = SKEWED) -> DataFrame:
    """Guarded log1p (x <= 0 and null -> 1) then robust scaling of each column."""
    out = df.select("*", *[guarded_log1p(c).alias(f"{c}_transformed") for c in cols])
    return robust_scale(out, [f"{c}_transformed" for c in cols], suffix="_scaled")


def minmax_scale(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """(x - min) / (max - min); a zero range gives 0."""
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols],
                 *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    outs = []
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        rng = (hi - lo) if lo is not None and hi is not None else 0.0
        outs.append((((F.col(c) - F.lit(lo)) / F.lit(rng)) if rng else F.lit(0.0)).alias(f"{c}{suffix}"))
    return df.select("*", *outs)


def markdown_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select("*", *[(F.col(c) > 0).cast("int").alias(f"{c}_flag") for c in cols])


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every ordered pair of columns, long form (col1, col2, corr).

    One aggregate pass of pairwise moments over the rows where both are present; a
    constant column gives null, not an error.
    """
    from tillcast.functions.numeric import guarded_corr
    names = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    pair = F.array(*[F.struct(F.lit(i).alias("i"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                     for i, (a, b) in enumerate(names)])
    # one row a pair, combined before the shuffle: a small aggregate that compiles, instead of
    # hundreds of moments side by side
    r = (df.select(F.explode(pair).alias("p")).groupBy(F.col("p.i").alias("i"))
         .agg(guarded_corr(F.col("p.x"), F.col("p.y")).alias("corr")))
    label = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in names])
    r = r.withColumn("n", F.get(label, "i"))
    both = F.array_distinct(F.array(F.struct(F.col("n.a").alias("col1"), F.col("n.b").alias("col2")),
                                    F.struct(F.col("n.b").alias("col1"), F.col("n.a").alias("col2"))))
    return r.select(F.explode(both).alias("k"), "corr").select("k.col1", "k.col2", "corr")
