"""Exploration queries (grouped means, sums, top/bottom lists and trends)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.numeric import r4
from tillcast.operators import explore as X
from tillcast.operators.prepare import MARKDOWNS
from tillcast.plans.registry import Views, register
from tillcast.plans.sqlbase import with_views

W = with_views(prepared=True)


def _r4(df, keep):
    return df.select(*[F.col(c) if c in keep else r4(c).alias(c) for c in df.columns])


@register("monthly_means", W + """
select month, r4(avg(fuel_price)) as avg_fuel_price, r4(avg(cpi)) as avg_cpi,
       r4(avg(unemployment)) as avg_unemployment, r4(avg(weekly_sales)) as avg_weekly_sales
from prepared group by month""")
def monthly_means(spark, sf_dir):
    out = X.group_stats(Views(spark, sf_dir).prepared, ["month"],
                        means=["fuel_price", "cpi", "unemployment", "weekly_sales"])
    return _r4(out, {"month"})


@register("monthly_markdowns", W + "select month, " + ", ".join(
    f"r4(avg({c})) as avg_{c}" for c in MARKDOWNS) + " from prepared group by month")
def monthly_markdowns(spark, sf_dir):
    out = X.group_stats(Views(spark, sf_dir).prepared, ["month"], means=MARKDOWNS)
    return _r4(out, {"month"})


@register("sales_by_type_holiday", W + """
select type, is_holiday, r4(avg(weekly_sales)) as avg_weekly_sales
from prepared group by grouping sets ((type), (is_holiday))""")
def sales_by_type_holiday(spark, sf_dir):
    p = Views(spark, sf_dir).prepared
    out = p.groupingSets([["type"], ["is_holiday"]], "type", "is_holiday").agg(
        F.avg("weekly_sales").alias("avg_weekly_sales"))
    return _r4(out, {"type", "is_holiday"})


@register("weekly_trend_by_type", W + """
select week_of_year, type, r4(sum(weekly_sales)) as total_sales
from prepared group by week_of_year, type""")
def weekly_trend_by_type(spark, sf_dir):
    out = Views(spark, sf_dir).prepared.groupBy("week_of_year", "type").agg(
        F.sum("weekly_sales").alias("total_sales"))
    return _r4(out, {"week_of_year", "type"})


# The store-department pair drawn by the trend query.
TREND_STORE, TREND_DEPT = 1, "ECONOMY"


@register("store_dept_trend", W + f"""
select week_of_year, r4(sum(weekly_sales)) as total_sales
from prepared where store = {TREND_STORE} and dept = '{TREND_DEPT}' group by week_of_year""")
def store_dept_trend(spark, sf_dir):
    p = Views(spark, sf_dir).prepared
    out = p.where((F.col("store") == TREND_STORE) & (F.col("dept") == TREND_DEPT)) \
           .groupBy("week_of_year").agg(F.sum("weekly_sales").alias("total_sales"))
    return _r4(out, {"week_of_year"})


@register("week_drivers", W + """
select week_of_year, r4(sum(weekly_sales)) as sum_weekly_sales, r4(avg(cpi)) as avg_cpi,
       r4(avg(unemployment)) as avg_unemployment, r4(avg(fuel_price)) as avg_fuel_price,
       r4(sum(total_markdown)) as sum_total_markdown
from prepared group by week_of_year""")
def week_drivers(spark, sf_dir):
    out = X.group_stats(Views(spark, sf_dir).prepared, ["week_of_year"],
                        means=["cpi", "unemployment", "fuel_price"],
                        sums=["weekly_sales", "total_markdown"])
    return _r4(out, {"week_of_year"})


def _tb_sql(item, metric_expr, k, group=None, agg="avg", source="prepared"):
    g = f"{group}, " if group else ""
    part = f"partition by {group} " if group else ""
    return f"""
select {g}{item}, r4(value) as value, side, rank from (
  select {g}{item}, value, 'top' as side,
         row_number() over ({part}order by value desc, {item}) as rank
  from (select {g}{item}, {agg}({metric_expr}) as value from {source} group by {g}{item}) a
  union all
  select {g}{item}, value, 'bottom' as side,
         row_number() over ({part}order by value asc, {item}) as rank
  from (select {g}{item}, {agg}({metric_expr}) as value from {source} group by {g}{item}) b
) t where rank <= {k}"""


@register("top_bottom_stores", W + _tb_sql("store", "weekly_sales", 3, group="type"))
def top_bottom_stores(spark, sf_dir):
    out = X.top_bottom(Views(spark, sf_dir).prepared, "store", "weekly_sales", 3, ["type"])
    return out.withColumn("value", r4("value"))


@register("normalised_top_bottom", W + _tb_sql("store", "weekly_sales / size", 3))
def normalised_top_bottom(spark, sf_dir):
    p = Views(spark, sf_dir).prepared.withColumn("sales_vs_size", F.col("weekly_sales") / F.col("size"))
    return X.top_bottom(p, "store", "sales_vs_size", 3).withColumn("value", r4("value"))


@register("top_bottom_depts", W + "select * from (" + _tb_sql("dept", "weekly_sales", 3, group="type")
          + ") x union all select 'ALL' as type, dept, value, side, rank from ("
          + _tb_sql("dept", "weekly_sales", 5) + ") y where side = 'top'")
def top_bottom_depts(spark, sf_dir):
    p = Views(spark, sf_dir).prepared
    by_type = X.top_bottom(p, "dept", "weekly_sales", 3, ["type"])
    overall = X.top_bottom(p, "dept", "weekly_sales", 5).where(F.col("side") == "top") \
               .select(F.lit("ALL").alias("type"), "dept", "value", "side", "rank")
    return by_type.unionByName(overall).withColumn("value", r4("value"))


def _trend_sql(item, metric_expr, k, agg):
    return W + f"""
, chosen as (select distinct {item}, side from ({_tb_sql(item, metric_expr, k, agg=agg)}) c)
select p.week_of_year, p.{item}, c.side, r4(sum(p.weekly_sales)) as total_sales
from prepared p join chosen c on c.{item} = p.{item}
group by p.week_of_year, p.{item}, c.side"""


@register("top_bottom_dept_trend", _trend_sql("dept", "weekly_sales", 5, "sum"))
def top_bottom_dept_trend(spark, sf_dir):
    p = Views(spark, sf_dir).prepared
    chosen = X.top_bottom(p, "dept", "weekly_sales", 5, agg="sum")
    return X.topk_trend(p, "dept", chosen).withColumn("total_sales", r4("total_sales"))


@register("top_bottom_store_trend", _trend_sql("store", "weekly_sales / size", 3, "avg"))
def top_bottom_store_trend(spark, sf_dir):
    p = Views(spark, sf_dir).prepared
    chosen = X.top_bottom(p.withColumn("n", F.col("weekly_sales") / F.col("size")), "store", "n", 3)
    return X.topk_trend(p, "store", chosen).withColumn("total_sales", r4("total_sales"))
