"""Preparation: fills, interpolation, the sales-features-stores join, calendar parts,
weekly spines and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.dates import iso_week, parse_dmy, week_ending_friday
from tillcast.functions.numeric import col_

MARKDOWNS = [f"markdown{i}" for i in range(1, 6)]


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls to 0.0 in the given columns (the markdown rule)."""
    return df.fillna(0.0, subset=cols)


def interpolate_linear(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Linear interpolation by row position inside each key group, ordered by ``order``.

    Leading nulls stay null, trailing nulls take the last value (pandas
    ``interpolate(method='linear')``). Two half-frame windows over one sort:
    the last non-null (position, value) behind and the first one ahead.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rn = F.col("_rn")
    out = df.withColumn("_rn", F.row_number().over(w))
    for c in cols:
        v = F.col(c)
        pos = F.when(v.isNotNull(), rn)
        p0, v0 = F.last(pos, ignorenulls=True).over(back), F.last(v, ignorenulls=True).over(back)
        p1, v1 = F.first(pos, ignorenulls=True).over(fwd), F.first(v, ignorenulls=True).over(fwd)
        out = out.withColumn(
            c,
            F.when(v.isNotNull(), v)
            .when(p0.isNull(), F.lit(None))
            .when(p1.isNull(), v0)
            .otherwise(v0 + (v1 - v0) * (rn - p0) / (p1 - p0)).cast("double"))
    return out.drop("_rn")


def calendar_parts(date: Column | str = "date") -> list[Column]:
    d = col_(date)
    return [F.year(d).cast("int").alias("year"), F.month(d).cast("int").alias("month"),
            iso_week(d).alias("week_of_year")]


def row_sum(cols: list[str]) -> Column:
    """Row sum that skips nulls (an all-null row sums to 0)."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total


def prepare(sales: DataFrame, features: DataFrame, stores: DataFrame) -> DataFrame:
    """sales LEFT JOIN (features LEFT JOIN stores) on (store, date, is_holiday).

    Markdown nulls become 0, cpi/unemployment are interpolated per store by
    date, calendar parts and ``total_markdown`` are added, is_holiday becomes 0/1.
    ``stores`` is one row per store and ``features`` one row per store-week, so
    AQE turns both joins into broadcasts while they are small and keeps a
    sort-merge join when they are not.
    """
    f = interpolate_linear(fill_zero(features, MARKDOWNS), ["store"], "date",
                           ["cpi", "unemployment"])
    f = f.join(stores, "store", "left")
    j = sales.join(f, ["store", "date", "is_holiday"], "left")
    return j.select(
        "store", "dept", "date", "weekly_sales", F.col("is_holiday").cast("int").alias("is_holiday"),
        "temperature", "fuel_price", *MARKDOWNS, "cpi", "unemployment", "type", "size",
        *calendar_parts("date"), row_sum(MARKDOWNS).alias("total_markdown"))


def parse_text_dates(df: DataFrame, col: str = "date") -> DataFrame:
    return df.withColumn(col, parse_dmy(col))


def weekly_spine(series: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Regular weekly index from each key's first to last date (explode of a sequence)."""
    bounds = series.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 7 days")))
                         .alias(date))


def fill_spine(series: DataFrame, keys: list[str], value: str, date: str = "date",
               fill: float | None = 0.0) -> DataFrame:
    """Series on its regular weekly spine; absent weeks get ``fill`` (None keeps null)."""
    spine = weekly_spine(series, keys, date)
    out = spine.join(series.select(*keys, date, value), [*keys, date], "left")
    if fill is not None:
        out = out.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))
    return out


def resample_week_fri(df: DataFrame, keys: list[str], ts: str, value: str,
                      how: str = "sum") -> DataFrame:
    """Weekly bins ending Friday (right-closed, right-labelled), absent weeks 0 for sums."""
    agg = F.sum(value) if how == "sum" else F.avg(value)
    binned = df.groupBy(*keys, week_ending_friday(ts).alias("week")).agg(agg.alias(value))
    return fill_spine(binned, keys, value, "week", 0.0 if how == "sum" else None)


def with_defaults(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """df with every column of ``cols``; those it lacks hold ``value`` in every row."""
    return df.select("*", *[F.lit(value).cast("double").alias(c) for c in cols if c not in df.columns])
