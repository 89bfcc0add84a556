"""Profiling: null and distinct counts, duplicates, describe, histogram, box-plot numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stack(wide: DataFrame, names: list[str], label: str, value: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) as ({label}, {value})")


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count): one pass, one row per column."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _stack(wide, df.columns, "column_name", "null_count")


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column_name, n_distinct), nulls not counted; ``approx`` uses HyperLogLog++."""
    if approx:
        return _stack(df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns]), df.columns,
                      "column_name", "n_distinct")
    # one (column, value) pair a row and column, combined before the shuffle; a single
    # aggregate of many distinct counts would copy every row for each of them
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in df.columns]))
    kinds = df.select(pairs.alias("p")).select("p.c", "p.v").distinct()
    return kinds.groupBy(F.col("c").alias("column_name")).agg(F.count("v").alias("n_distinct"))


def duplicate_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows that repeat an earlier identical row: sum(n - 1) over identical-row groups."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates")) \
            .select(F.lit(name).alias("table_name"), "n_rows", "n_duplicates")


def describe(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear), max of ``col`` per group."""
    from tillcast.functions.quantiles import exact_group_quantiles
    q = exact_group_quantiles(df, by, col, [0.25, 0.5, 0.75])
    out = df.groupBy(*by).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
    return out.join(q, by, "left").select(*by, "count", "mean", "std", "min", F.col("q0").alias("q25"),
                                          F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum falls in the last bin.

    The two bounds come back to the driver as scalars; the counting is one
    grouped aggregate with map-side combine.
    """
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = float(row["lo"]), float(row["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "count")


def box_stats(df: DataFrame, by: list[str], col: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest points within 1.5 IQR) and outlier counts per group.

    Quartiles are one grouped aggregate; the group table (one row per group)
    joins back to the rows for the conditional min/max/count pass.
    """
    from tillcast.functions.quantiles import exact_group_quantiles
    q = exact_group_quantiles(df, by, col, [0.25, 0.5, 0.75]).select(
        *by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - whisker * F.col("iqr")
    hi = F.col("q3") + whisker * F.col("iqr")
    x = F.col(col)
    j = df.join(q, by)
    return j.groupBy(*by, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(x >= lo, x)).alias("lower_whisker"),
        F.max(F.when(x <= hi, x)).alias("upper_whisker"),
        F.count_if((x < lo) | (x > hi)).alias("n_outliers"),
        F.count(x).alias("n"))
