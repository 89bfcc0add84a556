"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.numeric import r4
from tillcast.operators import profile as PR
from tillcast.plans.registry import Views, register
from tillcast.plans.sqlbase import with_views

FEATURE_COLS = ["store", "date", "is_holiday", "temperature", "fuel_price", "markdown1", "markdown2",
                "markdown3", "markdown4", "markdown5", "cpi", "unemployment"]
PREPARED_COLS = ["store", "dept", "date", "weekly_sales", "is_holiday", "temperature", "fuel_price",
                 "markdown1", "markdown2", "markdown3", "markdown4", "markdown5", "cpi",
                 "unemployment", "type", "size", "year", "month", "week_of_year", "total_markdown"]


@register("null_counts", with_views() + "\nunion all\n".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as null_count from features"
    for c in FEATURE_COLS))
def null_counts(spark, sf_dir):
    return PR.null_counts(Views(spark, sf_dir).features.select(*FEATURE_COLS))


@register("distinct_counts", with_views(prepared=True) + "\nunion all\n".join(
    f"select '{c}' as column_name, count(distinct {c}) as n_distinct from prepared"
    for c in PREPARED_COLS))
def distinct_counts(spark, sf_dir):
    return PR.distinct_counts(Views(spark, sf_dir).prepared.select(*PREPARED_COLS))


@register("duplicate_rows", with_views(prepared=True) + """
select 'prepared' as table_name, sum(n) as n_rows, sum(n - 1) as n_duplicates
from (select count(*) as n from prepared group by all_cols) a
union all
select 'store_profile' as table_name, sum(n), sum(n - 1)
from (select count(*) as n from stores group by type, size) b""".replace(
    "all_cols", ", ".join(PREPARED_COLS)))
def duplicate_rows(spark, sf_dir):
    v = Views(spark, sf_dir)
    return PR.duplicate_rows(v.prepared.select(*PREPARED_COLS), "prepared").unionByName(
        PR.duplicate_rows(v.stores.select("type", "size"), "store_profile"))


@register("histogram", with_views(prepared=True) + """
, b as (select min(weekly_sales) as lo, max(weekly_sales) as hi from prepared),
binned as (select cast(least(floor((p.weekly_sales - b.lo) / ((b.hi - b.lo) / 20)), 19) as integer) as bin,
                  b.lo, (b.hi - b.lo) / 20 as w
           from prepared p cross join b)
select bin, r4(lo + bin * w) as bin_lo, r4(lo + (bin + 1) * w) as bin_hi, count(*) as count
from binned group by bin, lo, w""")
def histogram(spark, sf_dir):
    h = PR.histogram(Views(spark, sf_dir).prepared, "weekly_sales", 20)
    return h.select("bin", r4("bin_lo").alias("bin_lo"), r4("bin_hi").alias("bin_hi"), "count")


@register("box_stats", with_views(prepared=True) + """
, q as (select type, quantile_cont(weekly_sales, 0.25) as q1, quantile_cont(weekly_sales, 0.5) as median,
               quantile_cont(weekly_sales, 0.75) as q3 from prepared group by type)
select q.type, r4(q1) as q1, r4(median) as median, r4(q3) as q3, r4(q3 - q1) as iqr,
       r4(min(case when p.weekly_sales >= q1 - 1.5e0 * (q3 - q1) then p.weekly_sales end)) as lower_whisker,
       r4(max(case when p.weekly_sales <= q3 + 1.5e0 * (q3 - q1) then p.weekly_sales end)) as upper_whisker,
       count(*) filter (where p.weekly_sales < q1 - 1.5e0 * (q3 - q1)
                          or p.weekly_sales > q3 + 1.5e0 * (q3 - q1)) as n_outliers,
       count(p.weekly_sales) as n
from prepared p join q on q.type = p.type group by q.type, q1, median, q3""")
def box_stats(spark, sf_dir):
    b = PR.box_stats(Views(spark, sf_dir).prepared, ["type"], "weekly_sales")
    return b.select("type", *[r4(c).alias(c) for c in ("q1", "median", "q3", "iqr", "lower_whisker",
                                                        "upper_whisker")], "n_outliers", "n")
