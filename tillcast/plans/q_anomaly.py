"""Anomaly-detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.numeric import r4, snap8
from tillcast.operators import anomaly
from tillcast.plans.registry import Views, register
from tillcast.plans.sqlbase import sales_cte, with_views
from tillcast.session import bucketed, ensure_checkpoint_dir, written

ROLLING_SQL = with_views() + """
select store, dept, date, weekly_sales, r4(z) as rolling_zscore,
       coalesce(cast(abs(z) > 2e0 as integer), 0) as rolling_anomaly
from (select *, (weekly_sales - avg(weekly_sales) over w)
                / (stddev_samp(weekly_sales) over w + 1e-5) as z
      from sales
      window w as (partition by store, dept order by date rows between 7 preceding and current row)) t
"""


@register("rolling_zscore", ROLLING_SQL)
def rolling_zscore(spark, sf_dir):
    v = Views(spark, sf_dir)
    out = anomaly.rolling_zscore(v.sales)
    return out.select("store", "dept", "date", "weekly_sales",
                      r4("rolling_zscore").alias("rolling_zscore"), "rolling_anomaly")



@register("rolling_zscore_by_supplier", ROLLING_SQL.replace(with_views(), "with " + sales_cte("p_brand", store="s_suppkey")))
def rolling_zscore_by_supplier(spark, sf_dir):
    """The flagship over supplier and brand, whose number of series grows with the data."""
    out = anomaly.rolling_zscore(Views(spark, sf_dir).supplier_sales)
    return out.select("store", "dept", "date", "weekly_sales",
                      r4("rolling_zscore").alias("rolling_zscore"), "rolling_anomaly")



def _rolling_out(df):
    return df.select("store", "dept", "date", "weekly_sales", r4("rolling_zscore").alias("rolling_zscore"), "rolling_anomaly")


@register("rolling_zscore_layer", ROLLING_SQL)
def rolling_zscore_layer(spark, sf_dir):
    """The flagship on a layer bucketed by series: no exchange before the window."""
    return _rolling_out(anomaly.rolling_zscore(bucketed(Views(spark, sf_dir).sales, ["store", "dept"], "date")))


@register("rolling_zscore_refreshed", ROLLING_SQL)
def rolling_zscore_refreshed(spark, sf_dir):
    """The flagship as a layer by month that was built without the latest eight weeks and without each
    series' corrected week, then brought up to date."""
    import uuid
    from tillcast.sources import refresh as R
    sales = written(Views(spark, sf_dir).sales)
    last = sales.agg(F.max("date")).first()[0]
    new = (F.col("date") > F.date_sub(F.lit(last), 56)) | (F.pmod(F.xxhash64("store", "dept", "date"), F.lit(997)) == 0)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rolling-{uuid.uuid4().hex}"
    month = F.date_format("date", "yyyy-MM")
    R.write_parts(anomaly.rolling_zscore(sales.where(~new)), path, month)
    R.refresh(sales, sales.where(new).select("store", "dept", "date"), path, anomaly.rolling_zscore, month, ["store", "dept"], back=7, on=7)
    return _rolling_out(spark.read.parquet(path))


from tillcast.plans.sqlbase import with_cleaned  # noqa: E402


@register("classical_decompose", with_cleaned() + """
select store, dept, date, weekly_sales, r4(s8(stk_trend)) as stk_trend,
       r4(s8(stk_season)) as stk_season, r4(s8(stk_resid)) as stk_resid, stk_anomaly
from decomposed""")
def classical_decompose(spark, sf_dir):
    out = anomaly.classical_decompose(Views(spark, sf_dir).prepared)
    return out.select("store", "dept", "date", "weekly_sales",
                      *[r4(snap8(c)).alias(c) for c in ("stk_trend", "stk_season", "stk_resid")],
                      "stk_anomaly")


@register("seasonal_medians", with_cleaned() + """
select week_of_year, r4(seasonal_median) as seasonal_median from medians""")
def seasonal_medians(spark, sf_dir):
    out = anomaly.seasonal_medians(Views(spark, sf_dir).prepared)
    return out.select("week_of_year", r4("seasonal_median").alias("seasonal_median"))


@register("seasonal_median_fill", with_cleaned() + """
select store, dept, date, weekly_sales, rolling_anomaly, stk_anomaly, final_anomaly,
       r4(weekly_sales_cleaned) as weekly_sales_cleaned
from cleaned""")
def seasonal_median_fill(spark, sf_dir):
    c = Views(spark, sf_dir).cleaned
    return c.select("store", "dept", "date", "weekly_sales", "rolling_anomaly", "stk_anomaly",
                    "final_anomaly", r4("weekly_sales_cleaned").alias("weekly_sales_cleaned"))


@register("anomaly_rates", with_cleaned() + """
select 'rolling_anomaly' as detector, r4(avg(rolling_anomaly) * 100) as percent from cleaned
union all select 'stk_anomaly', r4(avg(stk_anomaly) * 100) from cleaned
union all select 'final_anomaly', r4(avg(final_anomaly) * 100) from cleaned""")
def anomaly_rates(spark, sf_dir):
    out = anomaly.flag_rates(Views(spark, sf_dir).cleaned,
                             ["rolling_anomaly", "stk_anomaly", "final_anomaly"])
    return out.select("detector", r4("percent").alias("percent"))


@register("flag_crosstab", with_cleaned() + """
select count(*) filter (where rolling_anomaly = 1 and stk_anomaly = 1) as both_flags,
       count(*) filter (where rolling_anomaly = 1 and stk_anomaly = 0) as rolling_only,
       count(*) filter (where rolling_anomaly = 0 and stk_anomaly = 1) as stk_only,
       count(*) filter (where rolling_anomaly = 0 and stk_anomaly = 0) as neither
from cleaned""")
def flag_crosstab(spark, sf_dir):
    c = Views(spark, sf_dir).cleaned
    r, s = F.col("rolling_anomaly") == 1, F.col("stk_anomaly") == 1
    return c.agg(F.count_if(r & s).alias("both_flags"), F.count_if(r & ~s).alias("rolling_only"),
                 F.count_if(~r & s).alias("stk_only"), F.count_if(~r & ~s).alias("neither"))


def detector_features(v):
    """The five detector inputs: ratio features scaled as in the reference, plus codes."""
    from tillcast.operators.features import frequency_encode, group_mean_ratios, log_transform, robust_scale
    # the two scaler fits read the same ratio table: it is written once
    g = written(group_mean_ratios(written(v.prepared)))
    g = log_transform(g, ["sales_vs_store"])
    g = robust_scale(g, ["size", "sales_vs_dept"])
    g = frequency_encode(g, ["store", "dept"])
    cols = ["sales_vs_store_transformed_scaled", "dept_id_freq", "store_id_freq", "size_scaled",
            "sales_vs_dept_scaled"]
    return g.select("store", "dept", "date", "weekly_sales", *[F.col(c).cast("double").alias(c) for c in cols]), cols


@register("isolation_forest")
def isolation_forest(spark, sf_dir):
    from tillcast.operators.iforest import isolation_forest as iforest
    g, cols = detector_features(Views(spark, sf_dir))
    out = iforest(g, ["store", "dept", "date"], cols, n_trees=100, psi=256, contamination=0.002)
    return out.select("store", "dept", "date", "weekly_sales", "if_score", "if_anomaly")


LOF_FEATURES = ["sales_vs_dept_scaled", "sales_vs_store_transformed_scaled", "dept_id_freq", "store_id_freq",
                "size_scaled"]


def detector_ctes() -> list[str]:
    """The detector table ``pts`` in SQL: five scaled features a row."""
    from tillcast.plans.q_features import GM_CTE
    return [GM_CTE, """tr as (select *, case when sales_vs_store > 0 then ln(1 + sales_vs_store) else 1e0 end
                                     as sales_vs_store_transformed from gm)""",
            """qp as (select quantile_cont(sales_vs_store_transformed, 0.25) as a1,
                                      quantile_cont(sales_vs_store_transformed, 0.5) as a2,
                                      quantile_cont(sales_vs_store_transformed, 0.75) as a3,
                                      quantile_cont(size, 0.25) as b1, quantile_cont(size, 0.5) as b2,
                                      quantile_cont(size, 0.75) as b3,
                                      quantile_cont(sales_vs_dept, 0.25) as c1, quantile_cont(sales_vs_dept, 0.5) as c2,
                                      quantile_cont(sales_vs_dept, 0.75) as c3 from tr)""",
            """pts as (select t.store, t.dept, t.date, t.weekly_sales,
              (t.sales_vs_store_transformed - a2) / coalesce(nullif(a3 - a1, 0), 1e0) as sales_vs_store_transformed_scaled,
              (t.size - b2) / coalesce(nullif(b3 - b1, 0), 1e0) as size_scaled,
              (t.sales_vs_dept - c2) / coalesce(nullif(c3 - c1, 0), 1e0) as sales_vs_dept_scaled,
              cast(count(*) over (partition by t.dept) as double) as dept_id_freq,
              cast(count(*) over (partition by t.store) as double) as store_id_freq,
              count(*) over (partition by t.store, t.dept) as n_block
       from tr t cross join qp)"""]


def _lof_sql() -> str:
    from tillcast.plans.sqlbase import with_views
    f = LOF_FEATURES
    dist = " + ".join(f"power(a.{c} - b.{c}, 2)" for c in f)
    return with_views(*detector_ctes(),
                      f"""knn as (select * from (
         select a.store, a.dept, a.date as p, b.date as o, sqrt({dist}) as d, a.n_block,
                row_number() over (partition by a.store, a.dept, a.date order by sqrt({dist}), b.date) as r
         from pts a join pts b on a.store = b.store and a.dept = b.dept and a.date <> b.date) x
       where r <= least(40, n_block - 1))""",
                      """kd as (select store, dept, p, max(d) as kdist from knn group by store, dept, p)""",
                      """lrd as (select k.store, k.dept, k.p, 1e0 / (avg(greatest(kd.kdist, k.d)) + 1e-10) as lrd
         from knn k join kd on kd.store = k.store and kd.dept = k.dept and kd.p = k.o
         group by k.store, k.dept, k.p)""",
                      """lof as (select k.store, k.dept, k.p as date, s8(avg(lo.lrd) / max(lp.lrd)) as lof
         from knn k join lrd lo on lo.store = k.store and lo.dept = k.dept and lo.p = k.o
                    join lrd lp on lp.store = k.store and lp.dept = k.dept and lp.p = k.p
         group by k.store, k.dept, k.p)""",
                      """res as (select p.store, p.dept, p.date, p.weekly_sales, l.lof from pts p
         left join lof l on l.store = p.store and l.dept = p.dept and l.date = p.date)""",
                      prepared=True) + """
select store, dept, date, weekly_sales, r4(lof) as lof,
       coalesce(cast(lof > (select quantile_cont(lof, 0.995) from res) as integer), 0) as lof_anomaly
from res"""


@register("lof_blocked", _lof_sql())
def lof_blocked(spark, sf_dir):
    from tillcast.operators.lof import lof_blocked as lof
    from tillcast.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    g, _ = detector_features(Views(spark, sf_dir))
    # the detector table ends a long plan (preparation, windows, scaler fits): cut it once
    g = g.checkpoint()
    # inside a store-department block the frequency codes and size are constant, so the
    # distance is carried by the two ratio features alone (the constants add exactly 0)
    out = lof(g, ["store", "dept"], "date", LOF_FEATURES[:2], k=40, contamination=0.005)
    return out.select("store", "dept", "date", "weekly_sales", r4("lof").alias("lof"), "lof_anomaly")


def _lof_all(g, keys=("store", "dept", "date")):
    from tillcast.operators.lof import lof_all as lof
    return lof(written(g.withColumn("row", F.concat_ws("|", *keys))), "row", LOF_FEATURES, k=40, contamination=0.005)


@register("lof_all")
def lof_all(spark, sf_dir):
    """Local outlier factor with neighbours among all rows, over all five features."""
    g, _ = detector_features(Views(spark, sf_dir))
    out = _lof_all(g)
    return out.select("store", "dept", "date", "weekly_sales", r4("lof").alias("lof"), "lof_anomaly")


@register("stl_decompose")
def stl_decompose(spark, sf_dir):
    from tillcast.operators.stl import stl_decompose as stl
    return stl(Views(spark, sf_dir).prepared)


@register("detector_rates")
def detector_rates(spark, sf_dir):
    """Percent of weeks flagged by each of the four detectors."""
    from tillcast.operators.iforest import isolation_forest as iforest
    v = Views(spark, sf_dir)
    keys = ["store", "dept", "date"]
    g, cols = detector_features(v)
    g = written(g)
    forest = iforest(g, keys, cols, n_trees=100, psi=256, contamination=0.002).select(*keys, "if_anomaly")
    near = _lof_all(g).select(*keys, "lof_anomaly")
    flags = v.cleaned.select(*keys, "rolling_anomaly", "stk_anomaly").join(forest, keys).join(near, keys)
    out = anomaly.flag_rates(flags, ["rolling_anomaly", "stk_anomaly", "if_anomaly", "lof_anomaly"])
    return out.select("detector", r4("percent").alias("percent"))


@register("stl_cleaned")
def stl_cleaned(spark, sf_dir):
    """Sales repaired with STL in place of the moving-average decomposition."""
    return anomaly.clean_sales(Views(spark, sf_dir).prepared, decomposition="stl").select(
        "store", "dept", "date", "weekly_sales", "rolling_anomaly", "stk_anomaly", "final_anomaly", "weekly_sales_cleaned")
