"""Preparation queries: stand-in views, joins, fills, spines, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.numeric import r4
from tillcast.operators import prepare as P
from tillcast.plans.registry import Views, register
from tillcast.plans.sqlbase import with_views


def _r4_all(df, cols):
    return df.select(*[r4(c).alias(c) if c in cols else F.col(c) for c in df.columns])


PREPARED_COLS = ("store, dept, date, weekly_sales, is_holiday, temperature, fuel_price, markdown1, "
                 "markdown2, markdown3, markdown4, markdown5, r4(cpi) as cpi, "
                 "r4(unemployment) as unemployment, type, size, year, month, week_of_year, "
                 "r4(total_markdown) as total_markdown")


@register("sales_features_join", with_views(prepared=True) + f"select {PREPARED_COLS} from prepared")
def sales_features_join(spark, sf_dir):
    return _r4_all(Views(spark, sf_dir).prepared, {"cpi", "unemployment", "total_markdown"})


@register("parse_dates", with_views() + """
select store, dept, date_text, cast(strptime(date_text, '%d/%m/%Y') as date) as parsed_date
from (select store, dept, strftime(date, '%d/%m/%Y') as date_text from sales) t""")
def parse_dates(spark, sf_dir):
    s = Views(spark, sf_dir).sales
    t = s.select("store", "dept", F.date_format("date", "dd/MM/yyyy").alias("date_text"))
    return t.withColumn("parsed_date", P.parse_dmy("date_text"))


@register("markdown_total", with_views() + """
select store, date, coalesce(markdown1, 0e0) as markdown1, coalesce(markdown2, 0e0) as markdown2,
       coalesce(markdown3, 0e0) as markdown3, coalesce(markdown4, 0e0) as markdown4,
       coalesce(markdown5, 0e0) as markdown5,
       r4(coalesce(markdown1, 0e0) + coalesce(markdown2, 0e0) + coalesce(markdown3, 0e0)
             + coalesce(markdown4, 0e0) + coalesce(markdown5, 0e0)) as total_markdown
from features""")
def markdown_total(spark, sf_dir):
    f = P.fill_zero(Views(spark, sf_dir).features, P.MARKDOWNS)
    return f.select("store", "date", *P.MARKDOWNS, r4(P.row_sum(P.MARKDOWNS)).alias("total_markdown"))


@register("interpolate_linear", with_views(prepared=True) + """
select store, date, r4(cpi) as cpi, r4(unemployment) as unemployment
from features_filled""")
def interpolate_linear(spark, sf_dir):
    f = P.interpolate_linear(Views(spark, sf_dir).features, ["store"], "date", ["cpi", "unemployment"])
    return f.select("store", "date", r4("cpi").alias("cpi"), r4("unemployment").alias("unemployment"))


@register("weekly_spine", with_views() + """
select b.store, b.dept, b.date, s.weekly_sales, s.weekly_sales is null as is_gap
from (select store, dept, cast(unnest(generate_series(min(date), max(date), interval 7 day)) as date) as date
      from sales group by store, dept) b
left join sales s on s.store = b.store and s.dept = b.dept and s.date = b.date""")
def weekly_spine(spark, sf_dir):
    out = P.fill_spine(Views(spark, sf_dir).sales, ["store", "dept"], "weekly_sales", fill=None)
    return out.withColumn("is_gap", F.col("weekly_sales").isNull())


@register("resample_week_fri", with_views("""binned as (
  select c.c_nationkey as store, (cast(o.o_orderdate as date) + cast((5 - isodow(cast(o.o_orderdate as date)) + 7) % 7 as integer)) as week,
         cast(sum(cast(o.o_totalprice as decimal(18,2))) as double) as amount
  from orders o join customer c on c.c_custkey = o.o_custkey group by 1, 2)""") + """
select b.store, b.week, coalesce(x.amount, 0e0) as amount
from (select store, cast(unnest(generate_series(min(week), max(week), interval 7 day)) as date) as week
      from binned group by store) b
left join binned x on x.store = b.store and x.week = b.week""")
def resample_week_fri(spark, sf_dir):
    from tillcast.sources.tables import read_table
    from tillcast.functions.numeric import money
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    daily = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("store"), "o_orderdate", money("o_totalprice").alias("amount"))
    out = P.resample_week_fri(daily, ["store"], "o_orderdate", "amount")
    return out.select("store", "week", F.col("amount").cast("double").alias("amount"))


@register("store_dept_week", with_views(prepared=True) + """
select store, dept, date, weekly_sales, is_holiday, fuel_price, r4(cpi) as cpi,
       r4(unemployment) as unemployment, size,
       cast(weekofyear(date) as integer) as weekofyear, cast(month(date) as integer) as month,
       cast(year(date) as integer) as year
from (select store, dept, date, sum(weekly_sales) as weekly_sales, avg(is_holiday) as is_holiday,
             avg(fuel_price) as fuel_price, avg(cpi) as cpi, avg(unemployment) as unemployment,
             avg(size) as size
      from prepared group by store, dept, date) t""")
def store_dept_week(spark, sf_dir):
    from tillcast.operators.features import store_dept_week as sdw
    out = sdw(Views(spark, sf_dir).prepared, value="weekly_sales")
    return _r4_all(out, {"cpi", "unemployment"})


@register("calendar_features", with_views() + """
select store, dept, date, cast(year(date) as integer) as year, cast(month(date) as integer) as month,
       cast(weekofyear(date) as integer) as week_of_year, cast(isodow(date) - 1 as integer) as day_of_week,
       dayofyear(date) = 1 as is_year_start, month(date) = 12 and day(date) = 31 as is_year_end,
       cast(date - min(date) over (partition by store, dept) as integer) as days_since_start
from sales""")
def calendar_features(spark, sf_dir):
    from tillcast.operators.features import calendar_features as cf
    return cf(Views(spark, sf_dir).sales.select("store", "dept", "date"), ["store", "dept"])
