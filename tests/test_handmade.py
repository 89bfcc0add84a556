"""Hand-made frames with planted answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tillcast.operators import anomaly, basket, evaluate, features, forecast, prepare
from tillcast.functions.numeric import guarded_corr, guarded_log1p


def fridays(n, start=dt.date(2010, 2, 5)):
    return [start + dt.timedelta(weeks=i) for i in range(n)]


def test_spike_flags_exact_row(spark):
    ys = [100 + 10 * math.sin(2 * math.pi * i / 52) for i in range(120)]
    ys[60] *= 10
    df = spark.createDataFrame([(1, "d", d, float(y)) for d, y in zip(fridays(120), ys)],
                               "store int, dept string, date date, weekly_sales double")
    out = anomaly.rolling_zscore(df).orderBy("date").toPandas()
    assert out.loc[out.rolling_anomaly == 1].index.tolist() == [60]
    assert out.rolling_zscore.isna().iloc[0]
    # the moving-average decomposition needs several periods per phase to isolate a spike
    ys = [100 + 10 * math.sin(2 * math.pi * i / 52) for i in range(260)]
    ys[100] *= 10
    df = spark.createDataFrame([(1, "d", d, float(y)) for d, y in zip(fridays(260), ys)],
                               "store int, dept string, date date, weekly_sales double")
    dec = anomaly.classical_decompose(df).orderBy("date").toPandas()
    # the spike is flagged and carries the largest residual (its phase-mates absorb a share)
    assert dec.stk_anomaly.iloc[100] == 1
    assert dec.stk_resid.abs().idxmax() == 100
    ok = dec.stk_trend.notna()
    assert ((dec.stk_trend + dec.stk_season + dec.stk_resid - dec.weekly_sales)[ok].abs() < 1e-6).all()


def test_one_row_series(spark):
    df = spark.createDataFrame([(1, "d", dt.date(2010, 2, 5), 5.0)],
                               "store int, dept string, date date, weekly_sales double")
    r = anomaly.rolling_zscore(df).first()
    assert r.rolling_zscore is None and r.rolling_anomaly == 0
    d = anomaly.classical_decompose(df).first()
    assert d.stk_trend is None and d.stk_anomaly == 0


def test_z_flag_never_before_row_6(spark):
    ys = [0, 0, 0, 0, 0, 1000, 0, 0]
    df = spark.createDataFrame([(1, "d", d, float(y)) for d, y in zip(fridays(8), ys)],
                               "store int, dept string, date date, weekly_sales double")
    out = anomaly.rolling_zscore(df).orderBy("date").toPandas()
    assert out.rolling_anomaly.iloc[:5].sum() == 0
    # max |z| on row k is (k-1)/sqrt(k): 5/sqrt(6) > 2 on row 6
    assert out.rolling_anomaly.iloc[5] == 1


def test_interpolation_by_date(spark):
    ds = fridays(5)
    rows = [(1, ds[3], 3.0), (1, ds[0], None), (1, ds[4], None), (1, ds[1], 1.0), (1, ds[2], None)]
    df = spark.createDataFrame(rows, "store int, date date, cpi double")
    out = prepare.interpolate_linear(df, ["store"], "date", ["cpi"]).orderBy("date").toPandas()
    vals = [None if v != v else v for v in out.cpi.tolist()]
    assert vals == [None, 1.0, 2.0, 3.0, 3.0]


def test_gaps_spine(spark):
    ds = fridays(8)
    df = spark.createDataFrame([(1, ds[i], 1.0) for i in (0, 1, 3, 7)], "store int, date date, y double")
    out = prepare.fill_spine(df, ["store"], "y").orderBy("date").toPandas()
    assert len(out) == 8 and out.y.tolist() == [1, 1, 0, 1, 0, 0, 0, 1]


def test_text_dates(spark):
    df = spark.createDataFrame([("05/02/2010",), ("31/12/2010",)], "date string")
    out = prepare.parse_text_dates(df).toPandas()
    assert out.date.tolist() == [dt.date(2010, 2, 5), dt.date(2010, 12, 31)]


def test_guarded_log(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (2.0,)], "x double")
    out = [r[0] for r in df.select(guarded_log1p("x")).collect()]
    assert out[:3] == [1.0, 1.0, 1.0] and abs(out[3] - math.log(3)) < 1e-12


def test_constant_column_corr_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(guarded_corr("a", "b")).first()[0] is None


def test_robust_scale_iqr_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    out = features.robust_scale(df, ["x"]).toPandas()
    assert out.x_scaled.tolist() == [0.0, 0.0, 0.0]


def test_baskets_by_hand(spark):
    baskets = [{1, 2, 3}, {1, 2}, {1, 3}, {2, 3}, {1, 2, 3}]
    rows = [(i, dt.date(2010, 2, 5), str(it)) for i, b in enumerate(baskets) for it in b]
    items = spark.createDataFrame(rows, "store int, date date, item string")
    sets = {r.itemset: r.support for r in basket.frequent_itemsets(items, 0.1).collect()}
    assert sets == {"1": 0.8, "2": 0.8, "3": 0.8, "1, 2": 0.6, "1, 3": 0.6, "2, 3": 0.6, "1, 2, 3": 0.4}
    rules = basket.association_rules(basket.frequent_itemsets(items, 0.1), None).toPandas()
    r = rules[(rules.antecedents == "1") & (rules.consequents == "2, 3")].iloc[0]
    assert abs(r.confidence - 0.5) < 1e-12 and abs(r.lift - 0.5 / 0.6) < 1e-12
    # lift is symmetric
    a = rules.set_index(["antecedents", "consequents"]).lift
    assert abs(a[("1", "2, 3")] - a[("2, 3", "1")]) < 1e-12


def test_published_rule_arithmetic():
    # support / confidence = P(antecedent); the published rows share one antecedent (37)
    rows = [(0.3128, 0.7814), (0.3890, 0.9717)]
    ps = [s / c for s, c in rows]
    assert all(abs(p - 0.400) < 0.001 for p in ps)


def test_null_store_rank_and_join(spark):
    m = spark.createDataFrame([("chain", None, "a", 1.0, 0.5), ("chain", None, "b", 2.0, 0.9),
                               ("store", 1, "a", 1.0, 0.2), ("store", 1, "b", 1.0, 0.1)],
                              "level string, store int, model string, rmse double, r2 double")
    out = evaluate.results_with_best(m).toPandas()
    chain = out[out.level == "chain"]
    assert set(chain.best_model_name) == {"b"} and len(out) == 4


def test_naive_tail_padding(spark):
    ds = fridays(10)
    s = spark.createDataFrame([("store", 1, d, float(i + 1)) for i, d in enumerate(ds)],
                              "level string, store int, date date, y double")
    fc = forecast.naive_forecasts(s, horizon=2).where("model = 'naive_tail'").orderBy("date").toPandas()
    # train = 8 rows, test = rows 9, 10; naive tail = train rows 7, 8
    assert fc.forecast.tolist() == [7.0, 8.0] and fc.actual.tolist() == [9.0, 10.0]


def test_folds_never_train_on_later_dates(spark):
    ds = fridays(120)
    s = spark.createDataFrame([("store", 1, d, 1.0) for d in ds], "level string, store int, date date, y double")
    f = forecast.walk_forward_folds(s, horizon=8).toPandas()
    for _, g in f.groupby("fold"):
        assert g[g.role == "train"].date.max() < g[g.role == "val"].date.min()


def test_linear_r2_of_mean_is_zero(spark):
    fc = spark.createDataFrame([("store", 1, "m", 1.0, 2.0), ("store", 1, "m", 3.0, 2.0)],
                               "level string, store int, model string, actual double, forecast double")
    r = evaluate.forecast_metrics(fc).first()
    assert r.r2 == 0.0 and r.rmse == 1.0


def test_arx_recovers_linear_series(spark):
    from tillcast.operators.solve import arx_walk_forward, fourier_trend
    ds = fridays(200)
    s = spark.createDataFrame([("store", 1, d, 3.0 + 2.0 * i) for i, d in enumerate(ds)],
                              "level string, store int, date date, y double")
    fc = arx_walk_forward(s, horizon=8).toPandas()
    assert len(fc) == 8
    assert (fc.actual - fc.forecast).abs().max() < 1e-3
    ft = fourier_trend(s, horizon=20).toPandas()
    assert len(ft) == 20 and (ft.actual - ft.forecast).abs().max() < 1e-3


def test_isolation_forest_flags_far_point(spark):
    from tillcast.operators.iforest import isolation_forest
    import random
    rnd = random.Random(0)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(400)] + [(999, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = isolation_forest(df, ["id"], ["a", "b"], n_trees=50, psi=128, contamination=0.005).toPandas()
    assert out.loc[out.id == 999, "if_anomaly"].iloc[0] == 1
    assert out.if_anomaly.sum() <= 3
    assert out.if_score.idxmax() == out.index[out.id == 999][0]


def test_lof_blocked_matches_brute_force(spark):
    """Sorted-window k-NN with certification equals brute-force LOF on a small fixture."""
    import numpy as np
    from tillcast.operators.lof import lof_blocked
    from tillcast.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(3)
    pts = [(b, i, float(x), float(y)) for b in range(2) for i, (x, y) in enumerate(rng.normal(size=(60, 2)))]
    pts.append((0, 999, 8.0, 8.0))
    df = spark.createDataFrame(pts, "b int, id int, x double, y double")
    k = 5
    got = {(r.b, r.id): r.lof for r in lof_blocked(df, ["b"], "id", ["x", "y"], k=k, u="x").collect()}
    for b in range(2):
        sub = [(i, np.array([x, y])) for bb, i, x, y in pts if bb == b]
        ids = [i for i, _ in sub]
        X = np.array([v for _, v in sub])
        D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
        nn = {}
        for a in range(len(ids)):
            order = sorted((D[a, c], ids[c], c) for c in range(len(ids)) if c != a)[:k]
            nn[a] = order
        kd = {a: nn[a][-1][0] for a in nn}
        lrd = {a: 1.0 / (np.mean([max(kd[c], d) for d, _, c in nn[a]]) + 1e-10) for a in nn}
        for a in nn:
            want = np.mean([lrd[c] for _, _, c in nn[a]]) / lrd[a]
            assert abs(got[(b, ids[a])] - want) < 1e-7  # LOF is reported to 8 places
    far = got[(0, 999)]
    assert far == max(v for (b, _), v in got.items() if b == 0)


def test_stl_parts_add_up_and_find_spike(spark):
    from tillcast.operators.stl import stl_decompose
    ys = [100 + 20 * math.sin(2 * math.pi * i / 52) + 0.1 * i for i in range(208)]
    ys[120] += 400
    df = spark.createDataFrame([(1, "d", d, float(y)) for d, y in zip(fridays(208), ys)],
                               "store int, dept string, date date, weekly_sales double")
    out = stl_decompose(df).orderBy("date").toPandas()
    assert ((out.stl_trend + out.stl_season + out.stl_resid - out.weekly_sales).abs() < 1e-8).all()
    assert out.stl_anomaly.iloc[120] == 1
    assert out.stl_resid.abs().idxmax() == 120


def test_dbscan_blobs(spark):
    from tillcast.operators.dbscan import dbscan
    from tillcast.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    pts = [(i, 0.0 + 0.01 * i, 0.0) for i in range(10)] + [(100 + i, 5.0 + 0.01 * i, 5.0) for i in range(10)]
    pts.append((999, 50.0, 50.0))
    df = spark.createDataFrame(pts, "id int, x double, y double")
    lab = {r.id: r.cluster for r in dbscan(df, "id", ["x", "y"], eps=0.5, min_samples=3).collect()}
    assert lab[999] == -1
    assert {lab[i] for i in range(10)} == {0} and {lab[100 + i] for i in range(10)} == {1}


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from tillcast.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(7)
    a = rng.normal(size=5000).round(2)          # many ties
    rows = [(float(x), 3.0, None if i % 3 else float(i)) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, c double, s double")
    got = exact_quantiles(df, ["a", "c", "s"], [0.25, 0.5, 0.75], accuracy=1000)
    s = np.array([float(i) for i in range(len(a)) if i % 3 == 0])
    for name, arr in (("a", a), ("c", np.full(len(a), 3.0)), ("s", s)):
        want = np.quantile(arr, [0.25, 0.5, 0.75])
        assert np.allclose(got[name], want, rtol=0, atol=1e-12), name


def test_forecast_text_parsing(spark):
    from tillcast.sources.text import parse_series, parse_vector
    df = spark.createDataFrame([(1, "[1.5 2.5]", "2012-01-06 10\n2012-01-13 11")], "k int, v string, s string")
    v = [(r.pos, r.value) for r in parse_vector(df, "v", ["k"]).orderBy("pos").collect()]
    assert v == [(0, 1.5), (1, 2.5)]
    s = [(r.pos, str(r.date), r.value) for r in parse_series(df, "s", ["k"]).orderBy("pos").collect()]
    assert s == [(0, "2012-01-06", 10.0), (1, "2012-01-13", 11.0)]
