"""Choice of settings, boosted trees, moving-average terms and breaks on planted series."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.operators import basket, boost, evaluate, forecast, solve, tuning

DAY = dt.date(2010, 2, 5)


def frame(spark, series, extra=""):
    """series: {(level, store): values}; one row a week."""
    rows = [(level, store, DAY + dt.timedelta(weeks=k), *(v if isinstance(v, tuple) else (float(v),)))
            for (level, store), values in series.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "level string, store int, date date, y double" + extra)


# --- trees

def brute_tree(x, r, depth, min_leaf, l2):
    """Greedy tree by trying every cut; the prediction of each row."""
    if depth:
        best = None
        total = r.sum() ** 2 / (len(r) + l2)
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= cut
                if left.sum() >= min_leaf and (~left).sum() >= min_leaf:
                    gain = r[left].sum() ** 2 / (left.sum() + l2) + r[~left].sum() ** 2 / ((~left).sum() + l2) - total
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, j, cut
        if best and best[0] / 2 > 1e-9:
            left = x[:, best[1]] <= best[2]
            out = np.empty(len(r))
            out[left], out[~left] = (brute_tree(x[m], r[m], depth - 1, min_leaf, l2) for m in (left, ~left))
            return out
    return np.full(len(r), r.sum() / (len(r) + l2))


@pytest.mark.parametrize("depth, min_leaf, l2", [(1, 1, 0.0), (3, 2, 1.0), (4, 5, 0.5)])
def test_trees_equal_brute_force(depth, min_leaf, l2):
    g = np.random.default_rng(3)
    x = np.column_stack([g.normal(size=50), g.integers(0, 4, 50), g.normal(size=50)]).astype(float)
    y = np.where(x[:, 1] > 1, 5, 0) + x[:, 0] + g.normal(size=50)
    params = {"depth": depth, "min_leaf": min_leaf, "l2": l2, "step": 0.3}
    model = boost.Boosted(params).fit(x, y, 6)
    want = np.full(50, y.mean())
    for _ in range(6):
        want = want + 0.3 * brute_tree(x, y - want, depth, min_leaf, l2)
    assert np.allclose(model.predict(x), want, atol=1e-9)


def test_rounds_stop_where_validation_is_best():
    g = np.random.default_rng(5)
    x = g.normal(size=(120, 4))
    y = x[:, 0] + g.normal(size=120) * 2
    a, b = (x[:80], y[:80]), (x[80:], y[80:])
    model = boost.Boosted({"depth": 4, "step": 0.2, "min_leaf": 1}).fit(*a, 200, b, patience=200)
    losses = []
    whole = boost.Boosted({"depth": 4, "step": 0.2, "min_leaf": 1}).fit(*a, 200)
    ahead = np.full(40, whole.base)
    for t in whole.trees:
        ahead = ahead + whole._apply(t, b[0])
        losses.append(((b[1] - ahead) ** 2).mean())
    assert len(model.trees) == int(np.argmin(losses)) + 1 < 200


# --- halving

def test_folds_stay_in_the_train_part(spark):
    s = forecast.with_positions(frame(spark, {("store", 1): range(100), ("chain", None): range(60), ("store", 2): range(20)}))
    got = {(r.level, r.store, r.fold): (r.start, r.stop) for r in tuning.walk_forward_ranges(s, 8).collect()}
    assert got == {("store", 1, 0): (56, 64), ("store", 1, 1): (64, 72), ("store", 1, 2): (72, 80), ("chain", None, 0): (33, 41)}
    assert {(r.store, r.start) for r in tuning.position_ranges(s, 40, 8, 8).collect()} == {(1, 40), (1, 48), (1, 56), (1, 64), (1, 72), (None, 40)}
    assert {(r.store, r.fold) for r in tuning.last_folds(tuning.walk_forward_ranges(s, 8), 2).collect()} == {(1, 1), (1, 2), (None, 0)}


def test_halving_finds_the_planted_setting_and_keeps_the_best(spark):
    def planted_loss(table, params, budget, start):
        """Least for the setting that the series itself names in y, the sooner found the larger the budget."""
        want = table.column("y")[0].as_py()
        return None if params["k"] == 7 else abs(params["k"] - want) + 1 / budget + start / 1e6

    series = {("store", 1): [3.0] * 50, ("store", 2): [8.0] * 50, ("chain", None): [0.0] * 50}
    s = forecast.with_positions(frame(spark, series))
    folds = tuning.walk_forward_ranges(s, 4)
    settings = [{"k": k} for k in range(9)]
    table = tuning.halving(s, folds, settings, planted_loss, [10, 100], keep=3)
    rows = table.collect()
    assert {(r.level, r.store): r.setting for r in tuning.choice(table).collect()} == {("store", 1): 3, ("store", 2): 8, ("chain", None): 0}
    starts = {(r.store, r.fold): r.start for r in folds.collect()}
    for (level, store), y in series.items():
        grid = {k: np.mean([abs(k - y[0]) + 0.1 + a / 1e6 for (i, _), a in starts.items() if i == store]) for k in range(9) if k != 7}
        mine = [r for r in rows if (r.level, r.store, r.rung) == (level, store, 0)]
        assert len(mine) == 9 * sum(i == store for i, _ in starts)
        for r in mine:
            assert (r.loss is None) == (r.setting == 7) and (r.loss is None or r.mean_loss == pytest.approx(grid[r.setting]))
        kept = {r.setting for r in mine if r.survives}
        assert kept == set(sorted(grid, key=lambda k: (round(grid[k], 9), k))[:3])
        assert {r.setting for r in rows if (r.level, r.store, r.rung) == (level, store, 1)} == kept


def test_tree_losses_equal_a_grid_by_hand(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(70, 2))
    y = 100 + 20 * (x[:, 0] > 0) + g.normal(size=70)
    df = frame(spark, {("store", 1): [(float(v), float(a), float(b)) for v, (a, b) in zip(y, x)]}, ", a double, b double")
    s = forecast.with_positions(df)
    settings = [{"depth": 1, "log": 0}, {"depth": 3, "log": 1, "rows": 0.7}, {"depth": 2, "step": 0.3}]
    table = tuning.halving(s, tuning.walk_forward_ranges(s, 5), settings, boost.tree_loss(["a", "b"]), [5, 20], keep=2)
    for r in table.collect():
        start = 39 + 5 * r.fold
        p = settings[r.setting]
        log = bool(p.get("log", 1))
        m = boost.Boosted(p).fit(x[:start], np.log1p(y[:start]) if log else y[:start], r.budget)
        pred = m.predict(x[start:start + 5])
        assert r.loss == pytest.approx(float(np.sqrt(((y[start:start + 5] - (np.expm1(pred) if log else pred)) ** 2).mean())))
    fc = boost.series_trees(s, tuning.choice(table), settings, ["a", "b"], "t", 5).collect()
    assert [r.date for r in sorted(fc, key=lambda r: r.date)] == [DAY + dt.timedelta(weeks=56 + k) for k in range(5)]
    assert len({r.rounds for r in fc}) == 1 and max(abs(r.forecast - r.actual) for r in fc) < 10


def test_series_too_short_to_fit_have_no_rows(spark):
    s = forecast.with_positions(frame(spark, {("store", 1): [(float(k), 1.0) for k in range(12)], ("store", 2): [(1.0, 2.0)]}, ", a double"))
    table = tuning.halving(s, tuning.walk_forward_ranges(s, 3), [{}, {"depth": 1}], boost.tree_loss(["a"]), [2], keep=2)
    assert {r.loss for r in table.collect()} <= {None}
    chosen = spark.createDataFrame([("store", 1, 0), ("store", 2, 1)], "level string, store int, setting int")
    assert boost.series_trees(s, chosen, [{}, {}], ["a"], "t", 3).count() == 0
    assert tuning.halving(s.where("false"), tuning.walk_forward_ranges(s.where("false"), 3), [{}], boost.tree_loss(["a"]), [2]).count() == 0


# --- moving-average terms

def arma_values(n, phi, theta, seed, mean=50.0):
    g = np.random.default_rng(seed)
    e, t = g.normal(size=n + 100), np.zeros(n + 100)
    for k in range(1, n + 100):
        t[k] = phi * t[k - 1] + e[k] + theta * e[k - 1]
    return (t + mean)[100:]


def test_planted_moving_average_is_recovered(spark):
    series = {("store", k): arma_values(500, 0.6, 0.5, k) for k in range(8)}
    df = frame(spark, series)
    fc = solve.arma_walk_forward(df, horizon=1, season=None, ar=1, ma=1, holiday=False, with_beta=True).collect()
    beta = np.array([r.beta for r in fc])  # fitted on 400 weeks each
    assert len(beta) == 8
    assert abs(beta[:, 1].mean() - 0.6) < 0.05 and abs(beta[:, 2].mean() - 0.5) < 0.05


def test_arma_equals_least_squares_on_the_same_design(spark):
    y = arma_values(120, 0.4, 0.3, 3)
    n, train, order = 120, 96, 6
    lags = np.column_stack([np.ones(n), *[np.concatenate((np.full(k, np.nan), y[:-k])) for k in range(1, order + 1)]])
    first = np.linalg.lstsq(lags[order:train], y[order:train], rcond=None)[0]
    e = y - lags @ first
    x = np.column_stack([np.ones(n), np.append(np.nan, y[:-1]), np.append([np.nan] * 2, y[:-2]), np.append(np.nan, e[:-1])])
    got = sorted(solve.arma_walk_forward(frame(spark, {("store", 1): y}), horizon=5, season=None, ar=2, ma=1, long_order=order,
                                         holiday=False, with_beta=True).collect(), key=lambda r: r.date)
    assert len(got) == 5
    for k, r in enumerate(got):
        at = train + k
        want = np.linalg.lstsq(x[order + 1:at], y[order + 1:at], rcond=None)[0]
        assert np.allclose(r.beta, want, atol=1e-6) and r.forecast == pytest.approx(x[at] @ want, abs=1e-6)


def test_arma_choice_takes_the_least_mean_loss(spark):
    df = frame(spark, {("store", 1): np.abs(arma_values(160, 0.5, 0.8, 5)), ("chain", None): np.abs(arma_values(160, 0.9, 0.0, 6))})
    folds = tuning.last_folds(tuning.walk_forward_ranges(forecast.with_positions(df), 8), 3)
    settings = [{"season": s, "ma": q, "log": 1} for s in (4, 13) for q in (0, 1)]
    fc, losses = solve.tuned_arma(df, folds, settings, 32, 8)
    table = losses.toPandas()
    assert len(table) == 2 * 4 * 3 and table.loss.notna().all()
    for (level, store), own in table.groupby(["level", "store"], dropna=False):
        best = own.groupby("setting").loss.mean().idxmin()
        mine = fc.where((F.col("level") == level)).collect()
        assert {r.setting for r in mine} == {best} and len(mine) == 8


# --- breaks

def test_planted_break_is_kept_alone_and_optimal(spark):
    n, size = 250, 200
    t = np.arange(1, n + 1) / size
    at = 0.8 * 13 / 26
    y = np.expm1(5 + 0.3 * t - 2.0 * np.maximum(t - at, 0) + np.random.default_rng(2).normal(size=n) * 1e-3)
    fc, terms = solve.trend_breaks(frame(spark, {("store", 1): y}), horizon=20)
    rows = terms.collect()
    breaks = [r for r in rows if r.term == "break"]
    kept = [r for r in breaks if abs(r.coef) > 0.02]
    assert len(rows) == 34 and len(breaks) == 25
    assert [round(r.at, 9) for r in kept] == [round(at, 9)] and kept[0].coef == pytest.approx(-2.0, abs=0.05)
    bad = terms.where("term = 'break'").where(
        "case when coef = 0 then abs(gradient) > penalty * (1 + 1e-6) + 1e-7 else abs(gradient - sign(coef) * penalty) > penalty * 1e-6 + 1e-7 end")
    assert bad.count() == 0
    got = fc.toPandas()
    assert len(got) == 20 and (abs(got.forecast / got.actual - 1) < 0.02).all()


def test_lasso_equals_a_slow_search():
    g = np.random.default_rng(9)
    x, y = g.normal(size=(40, 3)), g.normal(size=40)
    b = solve.lasso(x.T @ x, x.T @ y, np.array([1.0, 1.0, 0.0]), 8.0)
    value = lambda v: ((y - x @ v) ** 2).sum() / 2 + 8 * (abs(v[0]) + abs(v[1]))
    for step in (1e-2, 1e-3):
        for d in np.vstack([np.eye(3), -np.eye(3), g.normal(size=(60, 3))]):
            assert value(b) <= value(b + step * d) + 1e-9


def test_short_series_have_no_terms(spark):
    fc, terms = solve.trend_breaks(frame(spark, {("store", 1): [5.0] * 12}), horizon=2)
    assert fc.count() == terms.count() == 0


# --- the rest

def test_items_of_different_weeks_are_correlated(spark):
    rows = [(DAY + dt.timedelta(weeks=k), "A" if k % 2 else "B", 10.0) for k in range(20)] + [(DAY, "C", 1.0), (DAY, "D", 0.0)]
    df = spark.createDataFrame(rows, "date date, dept string, weekly_sales_cleaned double")
    corr = basket.item_week_matrix_corr(df)
    got = {(r.dept1, r.dept2): r.corr for r in corr.collect()}
    assert len(got) == 16 and got["A", "B"] == pytest.approx(-1) and got["A", "A"] == pytest.approx(1)
    assert got["A", "D"] is None and got["A", "C"] == pytest.approx(-math.sqrt(1 / 19))
    assert [(r.dept1, r.dept2, r.sign) for r in basket.strong_pairs(corr).collect()] == [("A", "B", "negative")]


def test_a_missing_exogenous_column_gives_the_same_schema(spark):
    s = frame(spark, {("store", 1): range(30)})
    full = s.select("level", "store", "date", F.lit(1.0).alias("is_holiday"), F.lit(2.0).alias("total_markdown"))
    cols = ["is_holiday", "total_markdown"]
    a, b, c = (forecast.short_features(s, x, exog_cols=cols) for x in (full, full.drop("total_markdown"), None))
    assert [sorted((f.name, f.dataType) for f in x.schema) for x in (b, c)] == [sorted((f.name, f.dataType) for f in a.schema)] * 2
    assert a.count() == b.count() == c.count() == 22
    assert {r.total_markdown for r in b.collect()} == {0.0}


def test_models_are_ranked_on_the_weeks_all_have(spark):
    rows = [("store", 1, m, DAY + dt.timedelta(weeks=k), 1.0, None if (m, k) == ("a", 2) else 2.0) for m in "ab" for k in range(4) if (m, k) != ("b", 0)]
    fc = spark.createDataFrame(rows, "level string, store int, model string, date date, actual double, forecast double")
    got = evaluate.common_weeks(fc, 2).collect()
    assert sorted((r.model, (r.date - DAY).days // 7) for r in got) == [("a", 1), ("a", 3), ("b", 1), ("b", 3)]
