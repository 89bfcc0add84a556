"""Store and department profile queries (weekly totals, decomposition strength,
volatility, promotion share, correlations) and scaled segment features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.numeric import r4, snap8
from tillcast.operators import segment as S
from tillcast.plans.registry import Views, register
from tillcast.plans.sqlbase import with_cleaned
from tillcast.session import bucketed, written


def decompose_sql(src: str, key: str, y: str, name: str) -> list[str]:
    """CTEs with the moving-average decomposition of ``y`` per ``key`` (ordered by date)."""
    return [
        f"""{name}_a as (
  select *, count(*) over (partition by {key}) as n_obs,
         row_number() over (partition by {key} order by date) as rn,
         case when count(*) over (partition by {key}) >= 104
                   and lag({y}, 26) over wo is not null and lead({y}, 26) over wo is not null
              then cast((cast(lag({y}, 26) over wo as decimal(22,4)) + cast(lead({y}, 26) over wo as decimal(22,4))) * 0.5
                        + sum(cast({y} as decimal(22,4))) over w51 as double) / 52e0 end as d_trend
  from {src}
  window wo as (partition by {key} order by date),
         w51 as (partition by {key} order by date rows between 25 preceding and 25 following))""",
        f"""{name}_b as (
  select *, avg({y} - d_trend) over wp as pm, avg({y} - d_trend) over wp / count(*) over wp as pw
  from (select *, (rn - 1) % 52 as phase from {name}_a) t
  window wp as (partition by {key}, phase))""",
        f"""{name}_c as (
  select *, case when n_obs >= 104 then pm - sum(pw) over (partition by {key}) / 52e0 end as d_season
  from {name}_b)""",
        f"""{name} as (select *, {y} - d_trend - d_season as d_resid from {name}_c)""",
    ]


def profile_sql(key: str, value: str, flags: str) -> list[str]:
    weekly = f"""wk as (select {key}, date, sum({value}) as sales, sum(total_markdown) as markdown,
                    {flags} as flags from cleaned group by {key}, date)"""
    vol = f"""vol as (select *, case when count(sales) over w12 = 12
                        then quantile_cont(sales, 0.75) over w12 - quantile_cont(sales, 0.25) over w12 end as rolling_iqr
              from dec window w12 as (partition by {key} order by date rows between 11 preceding and current row))"""
    rq = f"""rq as (select {key}, quantile_cont(d_resid, 0.25) as rq1, quantile_cont(d_resid, 0.75) as rq3
             from dec group by {key})"""
    prof = f"""prof as (
  select v.{key}, sum(sales) as total_sales, stddev_samp(sales) as std_sales, max(sales) as max_sales,
         min(sales) as min_sales, median(sales) as median_sales, avg(sales) as mean_sales,
         1e0 - var_pop(d_resid) / nullif(var_pop(sales), 0) as seasonality_strength,
         1e0 - var_pop(d_resid) / nullif(var_pop(d_resid + d_trend), 0) as trend_strength,
         avg(rolling_iqr) as volatility, avg(case when markdown > 0 then 1e0 else 0e0 end) as promo_share,
         case when stddev_samp(markdown) * stddev_samp(sales) <> 0 then corr(markdown, sales) end as corr_markdown_sales,
         avg(flags) as anomalies_per_week, avg(markdown) as avg_markdown,
         avg(case when d_resid < rq1 - 1.5e0 * (rq3 - rq1) or d_resid > rq3 + 1.5e0 * (rq3 - rq1)
                  then 1e0 else 0e0 end) as iqr_outlier_rate
  from vol v left join rq on rq.{key} = v.{key} group by v.{key})"""
    return [weekly, *decompose_sql("wk", key, "sales", "dec"), vol, rq, prof]


STORE_PROFILE = profile_sql("store", "weekly_sales_cleaned", "sum(rolling_anomaly) + sum(stk_anomaly)")
DEPT_PROFILE = profile_sql("dept", "weekly_sales", "sum(rolling_anomaly)")
STORE_FEATURES_CTE = """sf as (
  select p.store, p.median_sales, p.std_sales, p.seasonality_strength, p.volatility, p.corr_markdown_sales,
         p.anomalies_per_week, p.mean_sales / nullif(st.size, 0) as sales_per_size
  from prof p left join stores st on st.store = p.store)"""


def _r(cols):
    return ", ".join(f"r4(s8({c})) as {c}" for c in cols)


def _rs(df, key):
    return df.select(key, *[r4(snap8(c)).alias(c) for c in df.columns if c != key])


@register("store_weekly", with_cleaned() + """
select store, date, r4(sum(weekly_sales_cleaned)) as sales from cleaned group by store, date""")
def store_weekly(spark, sf_dir):
    w = S.weekly_totals(Views(spark, sf_dir).cleaned, "store")
    return w.select("store", "date", r4("sales").alias("sales"))


@register("chain_weekly", with_cleaned() + """
select date, r4(sum(weekly_sales_cleaned)) as sales from cleaned group by date""")
def chain_weekly(spark, sf_dir):
    c = Views(spark, sf_dir).cleaned
    return c.groupBy("date").agg(r4(F.sum("weekly_sales_cleaned")).alias("sales"))


def _store_prof(spark, sf_dir):
    return S.profile(S.weekly_totals(Views(spark, sf_dir).cleaned, "store"), "store")


STATS = ["total_sales", "std_sales", "max_sales", "min_sales", "median_sales", "mean_sales"]


@register("series_stats", with_cleaned(*STORE_PROFILE) + f"select store, {_r(STATS)} from prof")
def series_stats(spark, sf_dir):
    return _rs(_store_prof(spark, sf_dir).select("store", *STATS), "store")


@register("season_strength", with_cleaned(*STORE_PROFILE) +
          f"select store, {_r(['seasonality_strength', 'trend_strength'])} from prof")
def season_strength(spark, sf_dir):
    return _rs(_store_prof(spark, sf_dir).select("store", "seasonality_strength", "trend_strength"), "store")


@register("volatility", with_cleaned(*STORE_PROFILE) + f"select store, {_r(['volatility'])} from prof")
def volatility(spark, sf_dir):
    return _rs(_store_prof(spark, sf_dir).select("store", "volatility"), "store")


@register("promo_share", with_cleaned(*STORE_PROFILE) + f"select store, {_r(['promo_share'])} from prof")
def promo_share(spark, sf_dir):
    return _rs(_store_prof(spark, sf_dir).select("store", "promo_share"), "store")


@register("markdown_corr", with_cleaned(*STORE_PROFILE) +
          f"select store, {_r(['corr_markdown_sales'])} from prof")
def markdown_corr(spark, sf_dir):
    return _rs(_store_prof(spark, sf_dir).select("store", "corr_markdown_sales"), "store")


@register("iqr_outliers", with_cleaned(*DEPT_PROFILE) + f"select dept, {_r(['iqr_outlier_rate'])} from prof")
def iqr_outliers(spark, sf_dir):
    c = Views(spark, sf_dir).cleaned
    prof = S.profile(S.weekly_totals(c, "dept", value="weekly_sales", flags=("rolling_anomaly",)), "dept")
    return _rs(prof.select("dept", "iqr_outlier_rate"), "dept")


@register("store_features", with_cleaned(*STORE_PROFILE, STORE_FEATURES_CTE) +
          f"select store, {_r(S.STORE_FEATURES)} from sf")
def store_features(spark, sf_dir):
    v = Views(spark, sf_dir)
    return _rs(S.store_features(v.cleaned, v.stores), "store")


@register("store_features_layer", with_cleaned(*STORE_PROFILE, STORE_FEATURES_CTE) +
          f"select store, {_r(S.STORE_FEATURES)} from sf")
def store_features_layer(spark, sf_dir):
    """Store features on weekly totals bucketed by store: no exchange before the windows."""
    v = Views(spark, sf_dir)
    return _rs(S.store_profile(bucketed(S.weekly_totals(v.cleaned, "store"), ["store"], "date"), v.stores), "store")


@register("dept_features", with_cleaned(*DEPT_PROFILE) + f"select dept, {_r(S.DEPT_FEATURES)} from prof")
def dept_features(spark, sf_dir):
    return _rs(S.dept_features(Views(spark, sf_dir).cleaned), "dept")


def _minmax_sql(key, cols, src, clip):
    logged = []
    for c in cols:
        if clip:
            logged.append(f"coalesce(case when greatest({c}, -1e0) > -1 then ln(1 + greatest({c}, -1e0)) end, 0e0) as {c}")
        else:
            logged.append(f"case when {c} > -1 then ln(1 + {c}) end as {c}")
    bounds = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in cols)
    outs = ", ".join(
        f"r4(s8(case when hi_{c} - lo_{c} = 0 or hi_{c} is null then 0e0 else ({c} - lo_{c}) / (hi_{c} - lo_{c}) end)) as {c}_scaled"
        for c in cols)
    return [f"lg as (select {key}, {', '.join(logged)} from {src})", f"bd as (select {bounds} from lg)"], \
        f"select {key}, {outs} from lg cross join bd"


_SF_CTES, _SF_SEL = _minmax_sql("store", S.STORE_FEATURES, "sf", clip=False)
_DF_CTES, _DF_SEL = _minmax_sql("dept", S.DEPT_FEATURES, "prof", clip=True)


@register("segment_feature_scale", with_cleaned(*STORE_PROFILE, STORE_FEATURES_CTE, *_SF_CTES) + _SF_SEL)
def segment_feature_scale(spark, sf_dir):
    v = Views(spark, sf_dir)
    out = S.log_minmax(S.store_features(v.cleaned, v.stores), "store", S.STORE_FEATURES)
    return out.select("store", *[r4(snap8(F.coalesce(F.col(c), F.lit(0.0)))).alias(c)
                                 for c in out.columns if c != "store"])


@register("dept_feature_scale", with_cleaned(*DEPT_PROFILE, *_DF_CTES) + _DF_SEL)
def dept_feature_scale(spark, sf_dir):
    out = S.log_minmax(S.dept_features(Views(spark, sf_dir).cleaned), "dept", S.DEPT_FEATURES, clip_at=-1.0)
    return out.select("dept", *[r4(snap8(c)).alias(c) for c in out.columns if c != "dept"])


def _vec(spark, sf_dir):
    from tillcast.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    v = Views(spark, sf_dir)
    scaled = S.log_minmax(S.store_features(v.cleaned, v.stores), "store", S.STORE_FEATURES)
    # a row per store ends a long plan: cut it before the iterative MLlib fits
    scaled = scaled.checkpoint()
    cols = [f"{c}_scaled" for c in S.STORE_FEATURES]
    return written(S.assemble(scaled, "store", cols)), len(cols)


@register("elbow")
def elbow(spark, sf_dir):
    vec, _ = _vec(spark, sf_dir)
    return S.elbow(vec)


@register("silhouette_sweep")
def silhouette_sweep(spark, sf_dir):
    vec, _ = _vec(spark, sf_dir)
    return S.silhouette_sweep(vec)


@register("pca")
def pca(spark, sf_dir):
    vec, p = _vec(spark, sf_dir)
    return S.pca(vec, "store", p)


@register("kmeans_segments")
def kmeans_segments(spark, sf_dir):
    vec, _ = _vec(spark, sf_dir)
    return S.kmeans_segments(vec, "store", 2)


@register("hierarchical")
def hierarchical(spark, sf_dir):
    """Ward linkage of the scaled store features, two clusters."""
    from tillcast.operators.ward import ward
    pts, cols = _scaled_store_features(spark, sf_dir)
    return ward(pts, "store", cols, 2)


def _silhouette_sql():
    cols = [f"{c}_scaled" for c in S.STORE_FEATURES]
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    sel = ", ".join(f"coalesce({c}, 0e0) as {c}" for c in cols)
    return with_cleaned(
        *STORE_PROFILE, STORE_FEATURES_CTE, *_SF_CTES,
        f"sc as (select store, {sel} from ({_SF_SEL.replace('r4(s8(', '((')}) t)",
        "lab as (select sc.*, s.type as c from sc join stores s on s.store = sc.store)",
        "num as (select c, cast(count(*) as double) as m from lab group by c)",
        f"""tot as (select a.store, a.c as own, b.c as other, sum(sqrt({d2})) as total
                    from lab a join lab b on true group by a.store, a.c, b.c)""",
        """ab as (select t.store, t.own, max(case when t.own = t.other and n.m > 1 then t.total / (n.m - 1) end) as inside,
                         min(case when t.own <> t.other then t.total / n.m end) as outside
                  from tot t join num n on n.c = t.other group by t.store, t.own)""") + """
select r4(s8(avg(case when inside is null or greatest(inside, outside) = 0 then 0e0 else (outside - inside) / greatest(inside, outside) end))) as silhouette,
       0e0 as standard_error, count(*) as n_scored, count(*) as n_rows, cast(count(distinct own) as integer) as n_clusters from ab"""


@register("silhouette_types", _silhouette_sql())
def silhouette_types(spark, sf_dir):
    """Euclidean silhouette of the stores' types on the scaled store features."""
    from tillcast.operators.silhouette import silhouette
    from tillcast.functions.numeric import snap8
    pts, cols = _scaled_store_features(spark, sf_dir)
    out = silhouette(Views(spark, sf_dir).stores.select("store", F.col("type").alias("cluster")), pts, "store", cols)
    return out.withColumn("silhouette", r4(snap8("silhouette")))


@register("silhouette_euclidean")
def silhouette_euclidean(spark, sf_dir):
    """Euclidean silhouette of k-means on the scaled store features for k = 2 to 10."""
    from tillcast.operators.silhouette import silhouette
    pts, cols = _scaled_store_features(spark, sf_dir)
    pts = written(pts)
    vec = written(S.assemble(pts, "store", cols))
    out = None
    for k in range(2, 11):
        one = silhouette(S.kmeans_segments(vec, "store", k), pts, "store", cols).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@register("segment_methods")
def segment_methods(spark, sf_dir):
    from tillcast.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    from pyspark.ml.functions import vector_to_array
    pts, cols = _scaled_store_features(spark, sf_dir)
    # every method sees the components that hold 95 % of the variance (a row per store)
    vec, k = S.pca_space(written(S.assemble(pts, "store", cols)), "store")
    vec = written(vec)
    axes = [f"pc{i}" for i in range(k)]
    pts = vec.select("store", *[vector_to_array("features")[i].alias(c) for i, c in enumerate(axes)])
    return S.segment_methods(vec, "store", 2, dbscan_input=(pts, axes, 0.3, 7))


@register("cluster_box")
def cluster_box(spark, sf_dir):
    """Box numbers of the store features by k-means cluster."""
    v = Views(spark, sf_dir)
    feats = written(S.store_features(v.cleaned, v.stores))
    scaled = S.log_minmax(feats, "store", S.STORE_FEATURES)
    vec = written(S.assemble(scaled, "store", [f"{c}_scaled" for c in S.STORE_FEATURES]))
    out = S.cluster_box(feats, S.kmeans_segments(vec, "store", 2), "store", S.STORE_FEATURES)
    return out.select("cluster", "feature", *[r4(c).alias(c) for c in ("q1", "median", "q3", "lower_whisker", "upper_whisker")],
                      "n_outliers", "n")


VIF_FEATURES = ["sales_vs_store_transformed_scaled", "dept_id_freq", "store_id_freq", "size_scaled", "sales_vs_dept_scaled"]


def _vif_sql():
    """The inverse correlation matrix by sweeping one feature after another."""
    from tillcast.plans.q_anomaly import detector_ctes
    from tillcast.plans.sqlbase import with_views
    n = range(len(VIF_FEATURES))
    rows = " union all ".join(f"select {i} as i, {j} as j, corr({VIF_FEATURES[i]}, {VIF_FEATURES[j]}) as v from pts" for i in n for j in n)
    steps = [f"s0 as ({rows})"]
    for k in n:
        steps.append(f"""s{k + 1} as (select a.i, a.j, case when a.i = {k} and a.j = {k} then 1 / p.v when a.i = {k} then a.v / p.v
                         when a.j = {k} then -a.v / p.v else a.v - r.v * c.v / p.v end as v
                    from s{k} a join s{k} p on p.i = {k} and p.j = {k} join s{k} r on r.i = a.i and r.j = {k} join s{k} c on c.i = {k} and c.j = a.j)""")
    names = "case i " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(VIF_FEATURES)) + " end"
    return with_views(*detector_ctes(), *steps, prepared=True) + f" select {names} as feature, r4(s8(v)) as vif from s{len(VIF_FEATURES)} where i = j"


@register("vif", _vif_sql())
def vif(spark, sf_dir):
    from tillcast.functions.numeric import snap8
    from tillcast.operators.features import frequency_encode, group_mean_ratios, log_transform, robust_scale
    v = Views(spark, sf_dir)
    g = log_transform(group_mean_ratios(written(v.prepared)), ["sales_vs_store"])
    g = robust_scale(g, ["size", "sales_vs_dept"])
    g = frequency_encode(g, ["store", "dept"])
    return S.vif(g.select(*[F.col(c).cast("double") for c in VIF_FEATURES]), VIF_FEATURES).withColumn("vif", r4(snap8("vif")))


def _scaled_store_features(spark, sf_dir):
    v = Views(spark, sf_dir)
    out = S.log_minmax(S.store_features(v.cleaned, v.stores), "store", S.STORE_FEATURES)
    return out.fillna(0.0), [f"{c}_scaled" for c in S.STORE_FEATURES]


def _dbscan_core_sql():
    cols = [f"{c}_scaled" for c in S.STORE_FEATURES]
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    sel = ", ".join(f"coalesce({c}, 0e0) as {c}" for c in cols)
    return with_cleaned(*STORE_PROFILE, STORE_FEATURES_CTE, *_SF_CTES,
                        f"sc as (select store, {sel} from ({_SF_SEL.replace('r4(s8(', '((')}) t)") + f"""
select a.store, count(*) as n_neighbours, count(*) >= 7 as is_core
from sc a join sc b on sqrt({d2}) <= 0.3
group by a.store"""


@register("dbscan_core", _dbscan_core_sql())
def dbscan_core(spark, sf_dir):
    from tillcast.operators.dbscan import core_points
    sc, cols = _scaled_store_features(spark, sf_dir)
    return core_points(sc, "store", cols, 0.3, 7)


def _dbscan_sql():
    cols = [f"{c}_scaled" for c in S.STORE_FEATURES]
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    sel = ", ".join(f"coalesce({c}, 0e0) as {c}" for c in cols)
    sql = with_cleaned(
        *STORE_PROFILE, STORE_FEATURES_CTE, *_SF_CTES,
        f"sc as (select store, {sel} from ({_SF_SEL.replace('r4(s8(', '((')}) t)",
        f"nb as (select a.store as a, b.store as b from sc a join sc b on sqrt({d2}) <= 0.3)",
        "core as (select a from nb group by a having count(*) >= 7)",
        "reach(id, r) as (select a, a from core union "
        "select x.id, n.b from reach x join nb n on n.a = x.r join core c on c.a = n.b)",
        "lab as (select id, min(r) as label from reach group by id)",
        "labels as (select id, label from lab union all "
        "select n.a, min(l.label) from nb n join lab l on l.id = n.b where n.a not in (select a from core) group by n.a)",
        "ranked as (select label, dense_rank() over (order by label) - 1 as cluster from (select distinct label from labels) z)")
    return sql.replace("with ", "with recursive ", 1) + """
select sc.store, cast(coalesce(k.cluster, -1) as integer) as cluster
from sc left join labels l on l.id = sc.store left join ranked k on k.label = l.label"""


@register("dbscan", _dbscan_sql())
def dbscan(spark, sf_dir):
    from tillcast.operators.dbscan import dbscan as db
    from tillcast.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    sc, cols = _scaled_store_features(spark, sf_dir)
    sc = sc.checkpoint()
    return db(sc, "store", cols, 0.3, 7)


@register("dept_segments")
def dept_segments(spark, sf_dir):
    """Department clusters by k-means (k = 2), bisecting k-means (k = 2) and DBSCAN (0.5, 5)
    on the clipped-log, min-max scaled department profile."""
    from tillcast.operators.dbscan import dbscan as db
    from tillcast.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    scaled = S.log_minmax(S.dept_features(Views(spark, sf_dir).cleaned), "dept", S.DEPT_FEATURES, clip_at=-1.0)
    scaled = scaled.fillna(0.0).checkpoint()
    cols = [f"{c}_scaled" for c in S.DEPT_FEATURES]
    vec = written(S.assemble(scaled, "dept", cols))
    km = S.kmeans_segments(vec, "dept", 2).withColumnRenamed("cluster", "kmeans")
    bk = S.bisecting_segments(vec, "dept", 2).withColumnRenamed("cluster", "bisecting_kmeans")
    dbl = db(scaled, "dept", cols, 0.5, 5).withColumnRenamed("cluster", "dbscan")
    return km.join(bk, "dept").join(dbl, "dept")
