"""Forecasting and evaluation queries: series, features, splits, folds, naive
baselines, metrics, ranking, winners, bands, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.numeric import r4
from tillcast.operators import boost as BO
from tillcast.operators import evaluate as EV
from tillcast.operators import forecast as FC
from tillcast.operators import tuning as TU
from tillcast.plans.registry import Views, register
from tillcast.plans.sqlbase import with_cleaned, with_views
from tillcast.session import written

HORIZON = 20
# The stores drawn side by side by the comparison query.
COMPARE = [1, 2]


def _spine(src, key):
    k = f"{key}, " if key else ""
    g = f"group by {key}" if key else ""
    return (f"select {k}cast(unnest(generate_series(min(date), max(date), interval 7 day)) as date) as date "
            f"from {src} {g}")


SERIES_CTES = [
    "ss as (select store, date, sum(weekly_sales) as y from prepared group by store, date)",
    "cs as (select date, sum(weekly_sales) as y from prepared group by date)",
    f"""series as (
  select 'store' as level, p.store, p.date, coalesce(s.y, 0e0) as y
  from ({_spine('ss', 'store')}) p left join ss s on s.store = p.store and s.date = p.date
  union all
  select 'chain', cast(null as integer), p.date, coalesce(c.y, 0e0)
  from ({_spine('cs', '')}) p left join cs c on c.date = p.date)""",
    """pos as (select *, row_number() over (partition by level, store order by date) as pos,
                      count(*) over (partition by level, store) as n,
                      cast(floor(count(*) over (partition by level, store) * 8e-1) as integer) as train_size
               from series)""",
    f"""fcw as (select *, coalesce(lag(y, {HORIZON}) over w, first_value(y) over w) as naive_tail,
                      lag(y, 52) over w as seasonal_naive
               from pos window w as (partition by level, store order by date))""",
    f"""fc as (
  select level, store, 'naive_tail' as model, date, y as actual, naive_tail as forecast from fcw
  where pos > train_size and pos <= train_size + {HORIZON} and n - train_size >= {HORIZON}
  union all
  select level, store, 'seasonal_naive', date, y, seasonal_naive from fcw
  where pos > train_size and pos <= train_size + {HORIZON} and n - train_size >= {HORIZON})""",
    """metrics as (select level, store, model, sqrt(avg(power(actual - forecast, 2))) as rmse,
                          1e0 - sum(power(actual - forecast, 2))
                                / case when count(actual) * var_pop(actual) <> 0 then count(actual) * var_pop(actual) end as r2,
                          count(*) as n
                   from fc where forecast is not null group by level, store, model)""",
    """ranked as (select *, row_number() over (partition by level, store
                                               order by r2 desc nulls last, rmse asc nulls last, model) as rank
                  from metrics)""",
    """best as (select store, model, r2, rmse from ranked where level = 'store' and rank = 1)""",
]
WF = with_views(*SERIES_CTES, prepared=True)


def _series(spark, sf_dir):
    return FC.level_series(Views(spark, sf_dir).prepared, "weekly_sales")


def _fc(spark, sf_dir):
    return FC.naive_forecasts(_series(spark, sf_dir), HORIZON)


def _metrics(spark, sf_dir):
    return EV.forecast_metrics(_fc(spark, sf_dir))


@register("train_test_split", WF + """
select level, store, date, r4(y) as y, pos, train_size, case when pos <= train_size then 'train' else 'test' end as split
from pos""")
def train_test_split(spark, sf_dir):
    t = FC.train_test_split(_series(spark, sf_dir))
    return t.select("level", "store", "date", r4("y").alias("y"), "pos", "train_size", "split")


def _fc_cols(df):
    return df.select("level", "store", "model", "date", r4("actual").alias("actual"),
                     r4("forecast").alias("forecast"))


@register("naive_tail", WF + "select level, store, model, date, r4(actual) as actual, r4(forecast) as forecast "
          "from fc where model = 'naive_tail'")
def naive_tail(spark, sf_dir):
    return _fc_cols(_fc(spark, sf_dir).where(F.col("model") == "naive_tail"))


@register("seasonal_naive", WF + "select level, store, model, date, r4(actual) as actual, r4(forecast) as forecast "
          "from fc where model = 'seasonal_naive'")
def seasonal_naive(spark, sf_dir):
    return _fc_cols(_fc(spark, sf_dir).where(F.col("model") == "seasonal_naive"))


def _mcols(df):
    return df.select(*[r4(c).alias(c) if c in ("rmse", "r2", "best_r2", "best_rmse") else F.col(c)
                       for c in df.columns])


@register("forecast_metrics", WF + "select level, store, model, r4(rmse) as rmse, r4(r2) as r2, n from metrics")
def forecast_metrics(spark, sf_dir):
    return _mcols(_metrics(spark, sf_dir))


@register("rank_models", WF + """
select level, store, model, r4(rmse) as rmse, r4(r2) as r2, n, rank, rank = 1 as is_best from ranked""")
def rank_models(spark, sf_dir):
    return _mcols(EV.rank_models(_metrics(spark, sf_dir)))


@register("results_with_best", WF + """
select r.level, r.store, r.model, r4(r.rmse) as rmse, r4(r.r2) as r2, r.n, r.rank, r.rank = 1 as is_best,
       b.model as best_model_name, r4(b.r2) as best_r2, r4(b.rmse) as best_rmse
from ranked r left join (select * from ranked where rank = 1) b
  on b.level is not distinct from r.level and b.store is not distinct from r.store""")
def results_with_best(spark, sf_dir):
    return _mcols(EV.results_with_best(_metrics(spark, sf_dir)))


@register("best_by_store", WF + "select store, model, r4(r2) as r2, r4(rmse) as rmse from best")
def best_by_store(spark, sf_dir):
    return _mcols(EV.best_by_store(_metrics(spark, sf_dir)))


@register("model_wins", WF + "select model, count(*) as wins from best group by model")
def model_wins(spark, sf_dir):
    return EV.best_by_store(_metrics(spark, sf_dir)).groupBy("model").agg(F.count(F.lit(1)).alias("wins"))


@register("pivot_model_r2", WF + """
select store, r4(max(case when model = 'naive_tail' then r2 end)) as naive_tail,
       r4(max(case when model = 'seasonal_naive' then r2 end)) as seasonal_naive
from metrics where level = 'store' group by store""")
def pivot_model_r2(spark, sf_dir):
    m = _metrics(spark, sf_dir).where(F.col("level") == "store")
    p = m.groupBy("store").pivot("model", ["naive_tail", "seasonal_naive"]).agg(F.first("r2"))
    return p.select("store", r4("naive_tail").alias("naive_tail"), r4("seasonal_naive").alias("seasonal_naive"))


@register("r2_bands", WF + """
select case when r2 >= 0.75 then 'Excellent (> 0.75)' when r2 >= 0.5 then ' (0.5 to 0.75)'
            when r2 >= 0.25 then 'Decent (0.25 to 0.5)' when r2 >= 0 then 'Weak Positive (0 to 0.5)'
            when r2 >= -1 then 'Reasonably Well (-1 to 0)' else 'Poor (< -1)' end as r2_category,
       count(*) as n_stores
from best group by 1""")
def r2_bands(spark, sf_dir):
    return EV.r2_bands(EV.best_by_store(_metrics(spark, sf_dir)))


@register("top_bottom_fit", WF + """
select * from (select store, model, r4(r2) as r2, r4(rmse) as rmse, 'top' as side,
                      row_number() over (order by r2 desc, store) as rank from best) a where rank <= 5
union all
select * from (select store, model, r4(r2) as r2, r4(rmse) as rmse, 'bottom' as side,
                      row_number() over (order by r2 asc, store) as rank from best) b where rank <= 5""")
def top_bottom_fit(spark, sf_dir):
    from pyspark.sql import Window
    b = EV.best_by_store(_metrics(spark, sf_dir))
    top = b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("r2"), "store"))) \
           .where("rank <= 5").withColumn("side", F.lit("top"))
    bot = b.withColumn("rank", F.row_number().over(Window.orderBy(F.asc("r2"), "store"))) \
           .where("rank <= 5").withColumn("side", F.lit("bottom"))
    return _mcols(top.unionByName(bot).select("store", "model", "r2", "rmse", "side", "rank"))


@register("r2_rmse_corr", WF + """
select r4(case when stddev_samp(r2) * stddev_samp(rmse) <> 0 then corr(r2, rmse) end) as r2_rmse_corr from metrics""")
def r2_rmse_corr(spark, sf_dir):
    return EV.r2_rmse_corr(_metrics(spark, sf_dir)).select(r4("r2_rmse_corr").alias("r2_rmse_corr"))


@register("describe_by_group", WF + """
select model, count(rmse) as count, r4(avg(rmse)) as mean, r4(stddev_samp(rmse)) as std, r4(min(rmse)) as min,
       r4(quantile_cont(rmse, 0.25)) as q25, r4(quantile_cont(rmse, 0.5)) as q50,
       r4(quantile_cont(rmse, 0.75)) as q75, r4(max(rmse)) as max
from metrics group by model""")
def describe_by_group(spark, sf_dir):
    from tillcast.operators.profile import describe
    d = describe(_metrics(spark, sf_dir), ["model"], "rmse")
    return d.select("model", "count", *[r4(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@register("chain_actual_vs_pred", WF + """
select model, date, r4(sum(actual)) as actual, r4(sum(forecast)) as predicted
from fc where level = 'store' group by model, date""")
def chain_actual_vs_pred(spark, sf_dir):
    c = EV.chain_actual_vs_pred(_fc(spark, sf_dir))
    return c.select("model", "date", r4("actual").alias("actual"), r4("predicted").alias("predicted"))


@register("compare_stores", WF + f"""
, chosen as (select b.store, b.model as best_model, b.rmse as best_rmse, st.type
             from best b left join stores st on st.store = b.store)
select c.store, s.date, 'history' as kind, r4(s.y) as value, c.best_model, r4(c.best_rmse) as best_rmse, c.type
from series s join chosen c on c.store = s.store where s.level = 'store' and s.store in ({', '.join(map(str, COMPARE))})
union all
select c.store, f.date, 'forecast', r4(f.forecast), c.best_model, r4(c.best_rmse), c.type
from fc f join chosen c on c.store = f.store and f.model = c.best_model
where f.level = 'store' and f.store in ({', '.join(map(str, COMPARE))})""")
def compare_stores(spark, sf_dir):
    v = Views(spark, sf_dir)
    s = written(_series(spark, sf_dir))
    fc = written(FC.naive_forecasts(s, HORIZON))
    out = EV.compare_stores(s, fc, EV.forecast_metrics(fc), v.stores, COMPARE)
    return out.select("store", "date", "kind", r4("value").alias("value"), "best_model",
                      r4("best_rmse").alias("best_rmse"), "type")


@register("eligible_series", WF + """
select level, store, count(*) as n_weeks, cast(floor(count(*) * 8e-1) as integer) as train_size,
       count(*) >= 24 as enough_weeks, count(*) >= 40 as arx_ok,
       floor(count(*) * 8e-1) >= 12 and least(count(*) - floor(count(*) * 8e-1), 8) >= 4 as split_ok,
       count(*) - floor(count(*) * 8e-1) >= 8 and floor(count(*) * 8e-1) > 52 as naive_ok
from series group by level, store""")
def eligible_series(spark, sf_dir):
    return FC.eligible_series(_series(spark, sf_dir), horizon=8)


@register("lag_baseline", with_cleaned("""sdw as (select store, dept, date, sum(weekly_sales_cleaned) as y
                                                   from cleaned group by store, dept, date)""", """
lb as (select *, lag(y, 12) over (partition by store, dept order by date) as y_baseline,
              max(date) over () as last_date from sdw)""") + """
select r4(sqrt(avg(power(y - y_baseline, 2)))) as rmse,
       r4(1e0 - sum(power(y - y_baseline, 2)) / nullif(count(y) * var_pop(y), 0)) as r2, count(*) as n
from lb where date > last_date - interval 140 day and y_baseline is not null""")
def lag_baseline(spark, sf_dir):
    from tillcast.operators.features import lags
    c = Views(spark, sf_dir).cleaned
    t = c.groupBy("store", "dept", "date").agg(F.sum("weekly_sales_cleaned").alias("y"))
    last = t.agg(F.max("date")).first()[0]
    t = lags(t, "y", [12], prefix="y_baseline")
    hold = t.where((F.col("date") > F.date_sub(F.lit(last), 7 * HORIZON)) & F.col("y_baseline_12").isNotNull())
    fc = hold.select(F.lit("x").alias("level"), F.lit(0).alias("store"), F.lit("lag_12").alias("model"),
                     F.col("y").alias("actual"), F.col("y_baseline_12").alias("forecast"))
    m = EV.forecast_metrics(fc)
    return m.select(r4("rmse").alias("rmse"), r4("r2").alias("r2"), "n")


@register("category_codes", with_cleaned() + """
select p.store, p.dept, p.date, s.store_code, d.dept_code from cleaned p
join (select store, cast(dense_rank() over (order by store) - 1 as integer) as store_code
      from (select distinct store from cleaned) x) s on s.store = p.store
join (select dept, cast(dense_rank() over (order by dept) - 1 as integer) as dept_code
      from (select distinct dept from cleaned) y) d on d.dept = p.dept""")
def category_codes(spark, sf_dir):
    from tillcast.operators.features import category_codes as cc
    c = Views(spark, sf_dir).cleaned.select("store", "dept", "date")
    return cc(c, ["store", "dept"])


@register("global_features", with_cleaned("""g0 as (
  select store, dept, date, sum(weekly_sales_cleaned) as weekly_sales, avg(is_holiday) as is_holiday,
         avg(fuel_price) as fuel_price, avg(cpi) as cpi, avg(unemployment) as unemployment, avg(size) as size
  from cleaned group by store, dept, date)""", """g1 as (
  select *, lag(weekly_sales, 1) over w as lag_1, lag(weekly_sales, 2) over w as lag_2,
         avg(weekly_sales) over (w rows between 4 preceding and 1 preceding) as rolling_4,
         avg(weekly_sales) over (w rows between 12 preceding and 1 preceding) as rolling_12,
         cast(weekofyear(date) as integer) as weekofyear, cast(month(date) as integer) as month,
         cast(year(date) as integer) as year
  from g0 window w as (partition by store, dept order by date))""") + """
select g.store, g.dept, g.date, r4(weekly_sales) as weekly_sales, is_holiday, fuel_price, r4(cpi) as cpi,
       r4(unemployment) as unemployment, size, weekofyear, month, year, r4(lag_1) as lag_1, r4(lag_2) as lag_2,
       r4(rolling_4) as rolling_4, r4(rolling_12) as rolling_12, s.store_code, d.dept_code
from g1 g
join (select store, cast(dense_rank() over (order by store) - 1 as integer) as store_code
      from (select distinct store from g0) x) s on s.store = g.store
join (select dept, cast(dense_rank() over (order by dept) - 1 as integer) as dept_code
      from (select distinct dept from g0) y) d on d.dept = g.dept
where lag_1 is not null and lag_2 is not null""")
def global_features(spark, sf_dir):
    g = FC.global_features(Views(spark, sf_dir).cleaned)
    rc = {"weekly_sales", "cpi", "unemployment", "lag_1", "lag_2", "rolling_4", "rolling_12"}
    return g.select(*[r4(c).alias(c) if c in rc else F.col(c) for c in g.columns])


LONG_COLS = ["lag_1", "lag_2", "lag_52", "roll_mean_4", "roll_mean_12", "roll_mean_52"]


@register("long_features", WF + """
, lf as (select *, lag(y, 1) over w as lag_1, lag(y, 2) over w as lag_2, lag(y, 52) over w as lag_52,
                case when count(y) over (w rows between 4 preceding and 1 preceding) = 4
                     then avg(y) over (w rows between 4 preceding and 1 preceding) end as roll_mean_4,
                case when count(y) over (w rows between 12 preceding and 1 preceding) = 12
                     then avg(y) over (w rows between 12 preceding and 1 preceding) end as roll_mean_12,
                case when count(y) over (w rows between 52 preceding and 1 preceding) = 52
                     then avg(y) over (w rows between 52 preceding and 1 preceding) end as roll_mean_52,
                cast(weekofyear(date) as integer) as weekofyear, cast(month(date) as integer) as month,
                cast(year(date) as integer) as year
         from series window w as (partition by level, store order by date))
select level, store, date, r4(y) as y, """ + ", ".join(f"r4({c}) as {c}" for c in LONG_COLS) + """,
       weekofyear, month, year
from lf where """ + " and ".join(f"{c} is not null" for c in LONG_COLS))
def long_features(spark, sf_dir):
    t = FC.long_features(_series(spark, sf_dir))
    return t.select(*[r4(c).alias(c) if c in LONG_COLS + ["y"] else F.col(c) for c in t.columns])


SHORT_COLS = ["lag_1", "lag_2", "lag_4", "lag_8", "rolling_mean_4", "rolling_mean_8", "rolling_std_4",
              "rolling_std_8"]


def _short_sql(markdown='x.total_markdown'):
    def full(fn, w):
        fr = f"(w rows between {w} preceding and 1 preceding)"
        return f"case when count(y) over {fr} = {w} then {fn}(y) over {fr} end"
    return WF + f"""
, sx as (select store, date, avg(is_holiday) as is_holiday, avg(total_markdown) as total_markdown
         from prepared group by store, date),
sf as (select s.*, cast(year(s.date) as integer) as year, cast(month(s.date) as integer) as month,
              cast(weekofyear(s.date) as integer) as week_of_year, cast(isodow(s.date) - 1 as integer) as day_of_week,
              cast(dayofyear(s.date) = 1 as integer) as is_year_start,
              cast(month(s.date) = 12 and day(s.date) = 31 as integer) as is_year_end,
              cast(s.date - min(s.date) over (partition by s.level, s.store) as integer) as days_since_start,
              lag(y, 1) over w as lag_1, lag(y, 2) over w as lag_2, lag(y, 4) over w as lag_4, lag(y, 8) over w as lag_8,
              {full('avg', 4)} as rolling_mean_4, {full('avg', 8)} as rolling_mean_8,
              {full('stddev_samp', 4)} as rolling_std_4, {full('stddev_samp', 8)} as rolling_std_8,
              x.is_holiday, {markdown} as total_markdown
       from series s left join sx x on x.store = s.store and x.date = s.date
       window w as (partition by s.level, s.store order by s.date))
select level, store, date, r4(y) as y, year, month, week_of_year, day_of_week, is_year_start, is_year_end,
       days_since_start, {", ".join(f"r4({c}) as {c}" for c in SHORT_COLS)},
       r4(is_holiday) as is_holiday, r4(total_markdown) as total_markdown
from sf where level = 'store' and {" and ".join(f"{c} is not null" for c in SHORT_COLS)}
      and is_holiday is not null and total_markdown is not null"""


SHORT_EXOG = ["is_holiday", "total_markdown"]


def _short_rows(spark, sf_dir, series, exog_cols=SHORT_EXOG):
    """Short-horizon feature rows of the store series."""
    p = Views(spark, sf_dir).prepared
    exog = p.groupBy("store", "date").agg(*[F.avg(c).alias(c) for c in exog_cols])
    return FC.short_features(series.where(F.col("level") == "store"), exog.withColumn("level", F.lit("store")), exog_cols=SHORT_EXOG)


def _short_out(t):
    rc = set(SHORT_COLS) | {"y", "is_holiday", "total_markdown"}
    return t.select(*[r4(c).alias(c) if c in rc else F.col(c) for c in t.columns])


@register("short_features", _short_sql())
def short_features(spark, sf_dir):
    return _short_out(_short_rows(spark, sf_dir, _series(spark, sf_dir)))


@register("short_features_default", _short_sql("0e0"))
def short_features_default(spark, sf_dir):
    """Sales without a markdown column: it is 0 in every row."""
    return _short_out(_short_rows(spark, sf_dir, _series(spark, sf_dir), ["is_holiday"]))


@register("walk_forward_folds", WF + f"""
, st as (select level, store, n, cast(floor(n * 7e-1) as integer) as start0 from (select distinct level, store, n from pos) x
         where n - {HORIZON} - 1 >= cast(floor(n * 7e-1) as integer)),
f as (select level, store, unnest(generate_series(start0, n - {HORIZON} - 1, {HORIZON})) as start from st),
fx as (select f.level, f.store, f.start, row_number() over (partition by f.level, f.store order by f.start) - 1 as fold from f)
select p.level, p.store, cast(fx.fold as integer) as fold, p.date,
       case when p.pos <= fx.start then 'train' else 'val' end as role
from pos p join fx on fx.level is not distinct from p.level and fx.store is not distinct from p.store
where p.pos <= fx.start + {HORIZON}""")
def walk_forward_folds(spark, sf_dir):
    f = FC.walk_forward_folds(_series(spark, sf_dir), HORIZON)
    return f.withColumn("fold", F.col("fold").cast("int"))


@register("position_folds", WF + """
, st as (select distinct level, store, n from pos where n >= 48),
f as (select level, store, unnest(generate_series(40, n - 8, 8)) as start from st),
fx as (select f.*, row_number() over (partition by level, store order by start) - 1 as fold from f)
select p.level, p.store, cast(fx.fold as integer) as fold, p.date,
       case when p.pos <= fx.start then 'train' else 'val' end as role
from pos p join fx on fx.level is not distinct from p.level and fx.store is not distinct from p.store
where p.pos <= fx.start + 8""")
def position_folds(spark, sf_dir):
    f = FC.position_folds(_series(spark, sf_dir))
    return f.withColumn("fold", F.col("fold").cast("int"))


@register("rolling_origin_folds", with_cleaned("""b as (select min(date) as lo, max(date) as hi from cleaned)""",
    """cuts as (select i as fold, lo + 182 + cast(floor(i * ((hi - 84) - (lo + 182)) / 3) as integer) as cut
               from b cross join (select unnest([0, 1, 2, 3]) as i) k)""") + """
select cast(c.fold as integer) as fold, c.cut, d.date,
       case when d.date <= c.cut then 'train' else 'val' end as role
from (select distinct date from cleaned) d cross join cuts c
where d.date <= c.cut + 84""")
def rolling_origin_folds(spark, sf_dir):
    return FC.rolling_origin_folds(Views(spark, sf_dir).cleaned)


@register("global_gbt")
def global_gbt(spark, sf_dir):
    from tillcast.operators.trees import global_gbt as gg
    return gg(FC.global_features(Views(spark, sf_dir).cleaned))


# Budgets of the two rungs (trees), and the number of settings tried: parameters of these queries.
RUNGS, TRIALS = [30, 120], 9
LONG_FEATURES = LONG_COLS + ["weekofyear", "month", "year"]
SHORT_FEATURES = SHORT_COLS + ["year", "month", "week_of_year", "day_of_week", "is_year_start", "is_year_end",
                               "days_since_start", "is_holiday", "total_markdown"]


def _long_rungs(series):
    """(feature rows, rung table) of the long-horizon trees; positions are those of the whole series."""
    pos = written(FC.with_positions(series))
    rows = written(FC.long_features(pos))
    return rows, TU.halving(rows, TU.walk_forward_ranges(pos, HORIZON), BO.random_settings(TRIALS), BO.tree_loss(LONG_FEATURES), RUNGS)


def _long_trees(series, rungs=None):
    rows, rungs = _long_rungs(series) if rungs is None else rungs
    return BO.series_trees(rows, TU.choice(rungs), BO.random_settings(TRIALS), LONG_FEATURES, "gbt_long", HORIZON)


@register("long_gbt")
def long_gbt(spark, sf_dir):
    """Boosted trees per series (stores and chain), settings chosen by successive halving, rounds by validation weeks."""
    return _long_trees(_series(spark, sf_dir))


@register("short_gbt")
def short_gbt(spark, sf_dir):
    """Boosted trees per store over 8 weeks, settings chosen on the last six position folds."""
    pos = written(FC.with_positions(_series(spark, sf_dir)))
    rows = written(_short_rows(spark, sf_dir, pos))
    folds = TU.last_folds(TU.position_ranges(pos.where(F.col("level") == "store")), 6)
    rungs = TU.halving(rows, folds, BO.random_settings(TRIALS), BO.tree_loss(SHORT_FEATURES), RUNGS)
    return BO.series_trees(rows, TU.choice(rungs), BO.random_settings(TRIALS), SHORT_FEATURES, "gbt_short", 8)


@register("tuning_folds", WF + f"""
, st as (select distinct level, store, train_size, cast(floor(train_size * 7e-1) as integer) as start0 from pos),
f as (select level, store, unnest(generate_series(start0, train_size - {HORIZON}, {HORIZON})) as start
      from st where start0 > 0 and start0 + {HORIZON} <= train_size)
select level, store, cast(row_number() over (partition by level, store order by start) - 1 as integer) as fold,
       cast(start as integer) as start, cast(start + {HORIZON} as integer) as stop from f""")
def tuning_folds(spark, sf_dir):
    """The folds that settings are chosen on: position ranges inside the train part, one row a fold."""
    return TU.walk_forward_ranges(FC.with_positions(_series(spark, sf_dir)), HORIZON)


@register("tuning_rungs", WF + f"""
, st as (select distinct level, store, train_size, cast(floor(train_size * 7e-1) as integer) as start0 from pos),
f as (select level, store, count(*) as n_folds from (
        select level, store, unnest(generate_series(start0, train_size - {HORIZON}, {HORIZON})) as start
        from st where start0 > 0 and start0 + {HORIZON} <= train_size) x group by level, store),
r as (select unnest([0, 1]) as rung, unnest({RUNGS}) as budget, unnest([{TRIALS}, 3]) as n_settings, unnest([3, 1]) as n_kept)
select f.level, f.store, cast(r.rung as integer) as rung, cast(r.budget as integer) as budget, cast(r.n_settings as bigint) as n_settings,
       f.n_folds, cast(r.n_kept as bigint) as n_kept, true as best_kept, true as losses_ordered
from f cross join r""")
def tuning_rungs(spark, sf_dir):
    """What each rung tried and kept in every series, and whether those kept have the least mean losses."""
    _, t = _long_rungs(_series(spark, sf_dir))
    of = t.groupBy("level", "store", "rung", "budget", "setting").agg(
        F.count("loss").alias("folds"), F.first("mean_loss").alias("mean"), F.avg("loss").alias("again"), F.first("rank").alias("rank"),
        F.first("survives").alias("survives"))
    return of.groupBy("level", "store", "rung", "budget").agg(
        F.count(F.lit(1)).alias("n_settings"), F.max("folds").alias("n_folds"), F.count_if("survives").alias("n_kept"),
        F.coalesce(F.max(F.when(F.col("survives"), F.col("mean"))) <= F.min(F.when(~F.col("survives"), F.col("mean"))), F.lit(True)).alias("best_kept"),
        ((F.min_by("mean", "rank") == F.min("mean")) & F.every(F.abs(F.col("again") - F.col("mean")) <= 1e-9 * F.col("mean"))).alias("losses_ordered"))


@register("forecast_results")
def forecast_results(spark, sf_dir):
    """Results of models with different columns in one table (missing columns null)."""
    s = _series(spark, sf_dir)
    naive = FC.naive_forecasts(s, HORIZON)
    gbt = _long_trees(s)
    out = naive.unionByName(gbt, allowMissingColumns=True)
    m = EV.forecast_metrics(out).select(F.col("level").alias("m_level"), F.col("store").alias("m_store"),
                                        F.col("model").alias("m_model"), "rmse", "r2")
    on = ((F.col("level") == F.col("m_level")) & F.col("store").eqNullSafe(F.col("m_store"))
          & (F.col("model") == F.col("m_model")))
    return out.join(m, on, "left").drop("m_level", "m_store", "m_model")


EXOG = ["total_markdown"]


def _with_markdown(spark, sf_dir):
    """Level series with the mean markdown of the week (of the store, or of the chain)."""
    p = Views(spark, sf_dir).prepared
    store = p.groupBy("store", "date").agg(F.avg("total_markdown").alias("total_markdown"))
    chain = p.groupBy("date").agg(F.avg("total_markdown").alias("total_markdown"))
    x = store.select(F.lit("store").alias("level"), "store", "date", "total_markdown").unionByName(
        chain.select(F.lit("chain").alias("level"), F.lit(None).cast("int").alias("store"), "date", "total_markdown"))
    x = x.select(F.col("level").alias("xl"), F.col("store").alias("xs"), F.col("date").alias("xd"), "total_markdown")
    s = _series(spark, sf_dir)
    on = (F.col("level") == F.col("xl")) & F.col("store").eqNullSafe(F.col("xs")) & (F.col("date") == F.col("xd"))
    return s.join(x, on, "left").drop("xl", "xs", "xd")


@register("fourier_trend")
def fourier_trend(spark, sf_dir):
    from tillcast.operators.solve import fourier_trend as ft
    return ft(_series(spark, sf_dir), HORIZON, log_target=True)


@register("trend_breaks")
def trend_breaks(spark, sf_dir):
    """Trend with breaks kept by the lasso out of 25 candidates, yearly terms and holiday: test forecasts."""
    from tillcast.operators.solve import trend_breaks as tb
    return tb(_series(spark, sf_dir), HORIZON)[0]


@register("trend_terms", WF + """
select distinct level, store, cast(34 as bigint) as n_terms, cast(25 as bigint) as n_candidates, true as optimal, true as free_terms_fit
from pos""")
def trend_terms(spark, sf_dir):
    """The optimality conditions of every series' breaks: the gradient is the signed penalty at a kept break, no larger elsewhere."""
    from tillcast.operators.solve import trend_breaks as tb
    t = tb(_series(spark, sf_dir), HORIZON)[1]
    slack = 1e-6 * F.col("penalty") + F.lit(1e-7)
    kept = F.abs(F.col("gradient") - F.signum("coef") * F.col("penalty")) <= slack
    held = F.when(F.col("coef") == 0, F.abs("gradient") <= F.col("penalty") + slack).otherwise(kept)
    return t.groupBy("level", "store").agg(
        F.count(F.lit(1)).alias("n_terms"), F.count("at").alias("n_candidates"), F.every(F.when(F.col("at").isNotNull(), held)).alias("optimal"),
        F.every(F.when(F.col("at").isNull(), F.col("coef").isNotNull() & ~F.isnan("coef"))).alias("free_terms_fit"))


@register("arx_walk_forward")
def arx_walk_forward(spark, sf_dir):
    from tillcast.operators.solve import arx_walk_forward as arx
    return arx(_with_markdown(spark, sf_dir), horizon=8, exog=EXOG, log_target=True)


@register("arma_walk_forward")
def arma_walk_forward(spark, sf_dir):
    """With a moving-average term: two lags, the yearly lag, one lagged innovation, holiday and markdown."""
    from tillcast.operators.solve import arma_walk_forward as arma
    return arma(_with_markdown(spark, sf_dir), horizon=8, exog=EXOG, log_target=True)


@register("grid_search_arx")
def grid_search_arx(spark, sf_dir):
    from tillcast.operators.solve import grid_search_arx as gs
    return gs(written(_with_markdown(spark, sf_dir)), exog=EXOG)


# Settings of the autoregression that are compared on the folds.
ARMA_SETTINGS = [{"season": s, "ma": q, "log": 1} for s in (4, 13, 26, 52) for q in (0, 1)]
# Models that are ranked together.
MODELS = ["naive_tail", "seasonal_naive", "fourier_trend", "trend_breaks", "arma", "gbt_long"]


def _arma(series, horizon):
    from tillcast.operators.solve import tuned_arma
    n_folds = 3
    folds = TU.last_folds(TU.walk_forward_ranges(FC.with_positions(series), horizon), n_folds)
    # folds start at steps of a horizon, so the latest may end up to a horizon before the train part does
    return tuned_arma(series, folds, ARMA_SETTINGS, (n_folds + 1) * horizon, horizon, exog=EXOG)


@register("arma_losses")
def arma_losses(spark, sf_dir):
    """Loss of every setting of the autoregression on every fold, its rank, and the one chosen."""
    return _arma(written(_with_markdown(spark, sf_dir)), HORIZON)[1]


def _all_models(spark, sf_dir):
    """Forecast rows of every model, on settings chosen inside the train weeks, over the same test weeks.

    The test weeks of a series are cut once, by position in the whole series; a week
    counts if all models forecast it.
    """
    from tillcast.operators.solve import fourier_trend as ft, trend_breaks as tb
    s = written(_with_markdown(spark, sf_dir))
    y = s.drop(*EXOG)
    parts = [FC.naive_forecasts(y, HORIZON),
             FC.apply_eligibility(ft(y, HORIZON, log_target=True), y, "enough_weeks", HORIZON),
             FC.apply_eligibility(tb(y, HORIZON)[0], y, "enough_weeks", HORIZON),
             FC.apply_eligibility(_arma(s, HORIZON)[0].drop("setting"), y, "arx_ok", HORIZON),
             FC.apply_eligibility(_long_trees(y).drop("setting", "rounds"), y, "split_ok", HORIZON)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(EV.common_weeks(out, len(MODELS)))


@register("model_ranking")
def model_ranking(spark, sf_dir):
    """Naive, trend, autoregression and boosted trees ranked together in every series."""
    return _mcols(EV.results_with_best(EV.forecast_metrics(_all_models(spark, sf_dir))))


@register("ranked_weeks", WF + f"""
select p.level, p.store, m.model, cast(count(*) as bigint) as n, min(p.date) as first_date, max(p.date) as last_date, r4(sum(p.y)) as actual
from pos p cross join (select unnest({MODELS}) as model) m
where p.pos > p.train_size and p.pos <= p.train_size + {HORIZON} and p.n - p.train_size >= {HORIZON}
group by p.level, p.store, m.model""")
def ranked_weeks(spark, sf_dir):
    """The weeks that each model is ranked on: the same for all models of a series."""
    return _all_models(spark, sf_dir).groupBy("level", "store", "model").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), r4(F.sum("actual")).alias("actual"))


@register("model_winners")
def model_winners(spark, sf_dir):
    """How many stores each model wins."""
    return EV.best_by_store(EV.forecast_metrics(_all_models(spark, sf_dir))).groupBy("model").agg(F.count(F.lit(1)).alias("wins"))


@register("inner_split", WF + """
select level, store, date, pos, train_size, cast(floor(train_size * 8e-1) as integer) as inner_size,
       case when pos <= floor(train_size * 8e-1) then 'train' when pos <= train_size then 'val' else 'test' end as split
from pos""")
def inner_split(spark, sf_dir):
    return FC.inner_split(_series(spark, sf_dir)).select("level", "store", "date", "pos", "train_size", "inner_size", "split")


@register("naive_short", WF + """
, w8 as (select *, lag(y, 8) over (partition by level, store order by date) as f from pos)
select level, store, 'naive_short' as model, date, r4(y) as actual, r4(f) as forecast from w8
where pos > train_size and pos <= train_size + 8 and n - train_size >= 8 and train_size > 52""")
def naive_short(spark, sf_dir):
    return _fc_cols(FC.naive_short(_series(spark, sf_dir)))


@register("chain_train_totals", WF + """
select date, r4(sum(y)) as train_total from pos where level = 'store' and pos <= train_size group by date""")
def chain_train_totals(spark, sf_dir):
    return FC.chain_train_totals(_series(spark, sf_dir)).select("date", r4("train_total").alias("train_total"))


@register("parse_forecast_text", WF + """
, txt as (
  select level, store, model,
         '[' || string_agg(printf('%.2f', forecast), ' ' order by date) || ']' as forecast_text,
         string_agg(strftime(date, '%Y-%m-%d') || ' ' || printf('%.2f', actual), chr(10) order by date) as actual_text
  from fc where model = 'naive_tail' group by level, store, model),
fv as (select level, store, model, unnest(string_split(trim(replace(replace(forecast_text, '[', ''), ']', '')), ' ')) as t,
              generate_subscripts(string_split(trim(replace(replace(forecast_text, '[', ''), ']', '')), ' '), 1) - 1 as pos
       from txt),
av as (select level, store, model, unnest(string_split(actual_text, chr(10))) as l,
              generate_subscripts(string_split(actual_text, chr(10)), 1) - 1 as pos from txt)
select a.level, a.store, a.model, cast(a.pos as integer) as pos, cast(split_part(a.l, ' ', 1) as date) as date,
       cast(split_part(a.l, ' ', 2) as double) as actual, cast(f.t as double) as forecast
from av a join fv f on f.level = a.level and f.store is not distinct from a.store and f.model = a.model and f.pos = a.pos""")
def parse_forecast_text(spark, sf_dir):
    from tillcast.sources import text as TX
    fc = _fc(spark, sf_dir).where(F.col("model") == "naive_tail")
    keys = ["level", "store", "model"]
    grouped = fc.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "actual", "forecast"))).alias("r"))
    txt = grouped.select(*keys, TX.vector_text(F.col("r.forecast")).alias("forecast_text"),
                         TX.series_text(F.col("r.date"), F.col("r.actual")).alias("actual_text"))
    fv = TX.parse_vector(txt, "forecast_text", keys).withColumnRenamed("value", "forecast")
    av = TX.parse_series(txt, "actual_text", keys).withColumnRenamed("value", "actual")
    on = ((av.level == fv.level) & av.store.eqNullSafe(fv.store) & (av.model == fv.model) & (av.pos == fv.pos))
    return av.join(fv, on).select(av.level, av.store, av.model, av.pos.cast("int").alias("pos"), av.date,
                                  av.actual, fv.forecast)
