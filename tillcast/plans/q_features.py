"""Feature, scaling and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.numeric import r4
from tillcast.operators import features as FE
from tillcast.operators.prepare import MARKDOWNS
from tillcast.plans.registry import Views, register
from tillcast.plans.sqlbase import with_views
from tillcast.session import written

GM_CTE = """gm as (
  select p.*, sm.store_mean, dm.dept_mean, sdm.store_dept_mean,
         p.weekly_sales / nullif(sm.store_mean, 0) as sales_vs_store,
         p.weekly_sales / nullif(dm.dept_mean, 0) as sales_vs_dept
  from prepared p
  join (select store, avg(weekly_sales) as store_mean from prepared group by store) sm on sm.store = p.store
  join (select dept, avg(weekly_sales) as dept_mean from prepared group by dept) dm on dm.dept = p.dept
  join (select store, dept, avg(weekly_sales) as store_dept_mean from prepared group by store, dept) sdm
    on sdm.store = p.store and sdm.dept = p.dept)"""


def _gm(spark, sf_dir):
    return FE.group_mean_ratios(written(Views(spark, sf_dir).prepared))


@register("group_mean_ratios", with_views(GM_CTE, prepared=True) + """
select store, dept, date, weekly_sales, r4(store_mean) as store_mean, r4(dept_mean) as dept_mean,
       r4(store_dept_mean) as store_dept_mean, r4(sales_vs_store) as sales_vs_store,
       r4(sales_vs_dept) as sales_vs_dept
from gm""")
def group_mean_ratios(spark, sf_dir):
    g = _gm(spark, sf_dir)
    return g.select("store", "dept", "date", "weekly_sales",
                    *[r4(c).alias(c) for c in ("store_mean", "dept_mean", "store_dept_mean",
                                               "sales_vs_store", "sales_vs_dept")])


@register("frequency_encode", with_views(prepared=True) + """
select p.store, p.dept, p.date, sc.store_id_freq, dc.dept_id_freq
from prepared p
join (select store, count(*) as store_id_freq from prepared group by store) sc on sc.store = p.store
join (select dept, count(*) as dept_id_freq from prepared group by dept) dc on dc.dept = p.dept""")
def frequency_encode(spark, sf_dir):
    p = Views(spark, sf_dir).prepared
    return FE.frequency_encode(p, ["store", "dept"]).select(
        "store", "dept", "date", "store_id_freq", "dept_id_freq")


def _log_sql() -> str:
    tr = ", ".join(
        f"case when {c} > 0 then ln(1 + {c}) else 1e0 end as {c}_transformed" for c in FE.SKEWED)
    qs = ", ".join(
        f"quantile_cont({c}_transformed, 0.25) as q1_{c}, quantile_cont({c}_transformed, 0.5) as md_{c}, "
        f"quantile_cont({c}_transformed, 0.75) as q3_{c}" for c in FE.SKEWED)
    outs = ", ".join(
        f"r4({c}_transformed) as {c}_transformed, "
        f"r4(({c}_transformed - md_{c}) / coalesce(nullif(q3_{c} - q1_{c}, 0), 1e0)) as {c}_scaled"
        for c in FE.SKEWED)
    return with_views(GM_CTE, f"tr as (select store, dept, date, {tr} from gm)",
                      f"qp as (select {qs} from tr)", prepared=True) + f"""
select store, dept, date, {outs} from tr cross join qp"""


@register("log_transform", _log_sql())
def log_transform(spark, sf_dir):
    g = _gm(spark, sf_dir)
    out = FE.log_transform(g)
    cols = []
    for c in FE.SKEWED:
        cols += [r4(f"{c}_transformed").alias(f"{c}_transformed"),
                 r4(f"{c}_transformed_scaled").alias(f"{c}_scaled")]
    return out.select("store", "dept", "date", *cols)


def _robust_sql() -> str:
    qs = ", ".join(
        f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.5) as md_{c}, "
        f"quantile_cont({c}, 0.75) as q3_{c}" for c in FE.UNSKEWED)
    outs = ", ".join(
        f"r4(({c} - md_{c}) / coalesce(nullif(q3_{c} - q1_{c}, 0), 1e0)) as {c}_scaled"
        for c in FE.UNSKEWED)
    return with_views(GM_CTE, f"qp as (select {qs} from gm)", prepared=True) + f"""
select store, dept, date, {outs} from gm cross join qp"""


@register("robust_scale", _robust_sql())
def robust_scale(spark, sf_dir):
    out = FE.robust_scale(_gm(spark, sf_dir), FE.UNSKEWED)
    return out.select("store", "dept", "date", *[r4(f"{c}_scaled").alias(f"{c}_scaled")
                                                 for c in FE.UNSKEWED])


@register("cyclic_encode", with_views(prepared=True) + """
select store, dept, date, year - 2010 as year_scaled,
       r4(sin(2e0 * pi() * month / 12e0)) as month_sin_scaled,
       r4(cos(2e0 * pi() * month / 12e0)) as month_cos_scaled,
       r4(cos(2e0 * pi() * week_of_year / 52e0)) as weekofyear_scaled
from prepared""")
def cyclic_encode(spark, sf_dir):
    out = FE.cyclic_encode(Views(spark, sf_dir).prepared)
    return out.select("store", "dept", "date", "year_scaled",
                      *[r4(c).alias(c) for c in ("month_sin_scaled", "month_cos_scaled",
                                                 "weekofyear_scaled")])


@register("markdown_flags", with_views(prepared=True) + """
select store, dept, date, """ + ", ".join(
    f"cast({c} > 0 as integer) as {c}_flag" for c in MARKDOWNS) + " from prepared")
def markdown_flags(spark, sf_dir):
    out = FE.markdown_flags(Views(spark, sf_dir).prepared, MARKDOWNS)
    return out.select("store", "dept", "date", *[f"{c}_flag" for c in MARKDOWNS])


CORR_COLS = ["weekly_sales", "temperature", "fuel_price", "cpi", "unemployment", "year", "month",
             "markdown1", "markdown2", "markdown3", "markdown4", "markdown5", "size", "total_markdown"]


def _corr_sql(cols, source="prepared", ctes=()) -> str:
    sel = []
    for a in cols:
        for b in cols:
            sel.append(f"select '{a}' as col1, '{b}' as col2, "
                       f"r4(case when stddev_samp({a}) * stddev_samp({b}) <> 0 then corr({a}, {b}) end) as corr "
                       f"from {source}")
    return with_views(*ctes, prepared=True) + "\nunion all\n".join(sel)


@register("corr_matrix", _corr_sql(CORR_COLS))
def corr_matrix(spark, sf_dir):
    out = FE.correlation_long(Views(spark, sf_dir).prepared, CORR_COLS)
    return out.select("col1", "col2", r4("corr").alias("corr"))


@register("vif_pair", with_views(prepared=True) + """
select 'fuel_price' as feature_a, 'temperature' as feature_b,
       r4(1e0 / (1e0 - power(corr(fuel_price, temperature), 2))) as vif
from prepared""")
def vif_pair(spark, sf_dir):
    from tillcast.functions.numeric import guarded_corr
    p = Views(spark, sf_dir).prepared
    r = guarded_corr("fuel_price", "temperature")
    return p.agg(r4(F.lit(1.0) / (F.lit(1.0) - F.pow(r, 2))).alias("vif")).select(
        F.lit("fuel_price").alias("feature_a"), F.lit("temperature").alias("feature_b"), "vif")
