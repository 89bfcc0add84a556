"""Least squares by groups or windows: Spark sums the normal equations (X'X, X'y),
a vectorised numpy solve in an Arrow pandas UDF turns each moment row into
coefficients. Used by the Fourier-trend and ARX forecasters.

The moments of a series are p(p+1)/2 + p numbers whatever its length, so the
solve step moves a few hundred bytes per fit; refitting at every step of a
walk-forward is a running window sum, not a new pass over the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment_terms(xs: list[Column], y: Column) -> list[Column]:
    """Row-wise products: upper triangle of x x' then x y (order fixed)."""
    terms = []
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            terms.append(xs[i] * xs[j])
    terms += [x * y for x in xs]
    return terms


def _solve_batch(m: np.ndarray, p: int, ridge: float) -> np.ndarray:
    """Coefficients of every row's normal equations; NaN where a moment is not finite.

    Each system is scaled to a unit diagonal first, so that the ridge weighs every
    column alike however large sales are; the scaled systems are solved as one stack.
    """
    n = m.shape[0]
    a = np.zeros((n, p, p))
    iu = np.triu_indices(p)
    a[:, iu[0], iu[1]] = m[:, : len(iu[0])]
    a = a + np.transpose(a, (0, 2, 1)) - a * np.eye(p)[None]
    b = m[:, len(iu[0]):]
    out = np.full((n, p), np.nan)
    ok = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    if ok.any():
        a, b = a[ok], b[ok]
        d = np.sqrt(np.einsum("nii->ni", a))
        d = np.where(d > 0, d, 1.0)
        a = a / d[:, :, None] / d[:, None, :] + ridge * np.eye(p)[None]
        out[ok] = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-10, hermitian=True), b / d) / d
    return out


def solver(p: int, ridge: float = 1e-12):
    """pandas UDF: array<double> of moments -> array<double> of p coefficients."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(moments: pd.Series) -> pd.Series:
        if len(moments) == 0:
            return pd.Series([], dtype=object)
        size = p * (p + 1) // 2 + p
        ok = [v is not None and len(v) == size and all(x is not None for x in v) for v in moments]
        res: list = [None] * len(moments)
        idx = [i for i, good in enumerate(ok) if good]
        if idx:
            m = np.vstack([np.asarray(moments.iloc[i], dtype=float) for i in idx])
            beta = _solve_batch(m, p, ridge)
            for i, row in zip(idx, beta):
                res[i] = None if np.isnan(row).any() else row.tolist()
        return pd.Series(res, dtype=object)
    return solve


def predict(beta: Column, xs: list[Column]) -> Column:
    return sum((beta[i] * x for i, x in enumerate(xs)), F.lit(0.0))


def fourier_design(t: Column, woy: Column, holiday: Column, changepoints=(0.25, 0.5, 0.75),
                   order: int = 3) -> list[Column]:
    """Intercept, trend, hinge terms at change points, yearly sin/cos pairs, holiday flag."""
    xs = [F.lit(1.0), t]
    xs += [F.greatest(t - F.lit(c), F.lit(0.0)) for c in changepoints]
    for k in range(1, order + 1):
        ang = F.lit(2.0 * math.pi * k / 52.1775) * woy
        xs += [F.sin(ang), F.cos(ang)]
    xs.append(holiday.cast("double"))
    return xs


def _log(y: Column) -> Column:
    return F.log1p(F.greatest(y, F.lit(0.0)))


def _fourier_rows(series: DataFrame, keys: list[str], train_frac: float, order: int, log_target: bool) -> tuple[DataFrame, list[Column]]:
    from tillcast.functions.dates import is_holiday_week, iso_week
    from tillcast.operators.forecast import with_positions
    s = with_positions(series, keys, train_frac)
    t = F.col("pos") / F.col("train_size")
    xs = fourier_design(t, iso_week("date"), is_holiday_week("date"), order=order)
    s = s.select("*", *[x.alias(f"x{i}") for i, x in enumerate(xs)],
                 (_log(F.col("y")) if log_target else F.col("y")).alias("_t"))
    return s, [F.col(f"x{i}") for i in range(len(xs))]


def fourier_fit(series: DataFrame, train_frac: float = 0.8, keys: list[str] = ("level", "store"), order: int = 3,
                log_target: bool = False, model: str = "fourier_trend", version: str = "1") -> DataFrame:
    """Model table (keys, model, version, params, coef): one row a series, fitted on its train part by grouped normal equations."""
    keys = list(keys)
    s, xc = _fourier_rows(series, keys, train_frac, order, log_target)
    train = s.where(F.col("pos") <= F.col("train_size"))
    mom = train.groupBy(*keys).agg(F.array(*[F.sum(c) for c in moment_terms(xc, F.col("_t"))]).alias("m"))
    params = F.create_map(F.lit("order"), F.lit(str(order)), F.lit("log_target"), F.lit(str(log_target).lower()))
    return mom.select(*keys, F.lit(model).alias("model"), F.lit(version).alias("version"), params.alias("params"),
                      solver(len(xc))("m").alias("coef"))


def fourier_score(series: DataFrame, table: DataFrame, horizon: int = 20, train_frac: float = 0.8,
                  keys: list[str] = ("level", "store"), order: int = 3, log_target: bool = False) -> DataFrame:
    """Forecasts of the first ``horizon`` test weeks by the coefficients of a model table, joined by series."""
    keys = list(keys)
    s, xc = _fourier_rows(series, keys, train_frac, order, log_target)
    test = s.where((F.col("pos") > F.col("train_size")) & (F.col("pos") <= F.col("train_size") + horizon)
                   & (F.col("n") - F.col("train_size") >= horizon))
    beta = table.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "model", "coef")
    pred = predict(F.col("coef"), xc)
    return test.join(beta, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]).select(
        *keys, "model", "date", F.col("y").alias("actual"), (F.expm1(pred) if log_target else pred).alias("forecast"))


def fourier_trend(series: DataFrame, horizon: int = 20, train_frac: float = 0.8,
                  keys: list[str] = ("level", "store"), order: int = 3, log_target: bool = False,
                  model: str = "fourier_trend") -> DataFrame:
    """Piecewise-linear trend + yearly Fourier terms + holiday flag per series, fit on the
    train part by grouped normal equations, forecast over the first ``horizon`` test weeks.
    The target is log1p(max(y, 0)), mapped back with expm1, unless ``log_target`` is off."""
    table = fourier_fit(series, train_frac, keys, order, log_target, model)
    return fourier_score(series, table, horizon, train_frac, keys, order, log_target)


def _walk_forward(s: DataFrame, xs: list[Column], complete: Column, keys: list[str], horizon: int, val_weeks: int,
                  log_target: bool, model: str) -> DataFrame:
    """One-step forecasts of ``_t`` on ``xs``, refit before every step by running moments over the complete rows."""
    p = len(xs)
    s = s.select("*", *[x.alias(f"x{i}") for i, x in enumerate(xs)], complete.alias("_full"))
    xc = [F.col(f"x{i}") for i in range(p)]
    past = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    terms = moment_terms(xc, F.col("_t"))
    s = s.select("*", F.array(*[F.sum(F.when(F.col("_full"), c)).over(past) for c in terms]).alias("m"),
                 F.sum(F.col("_full").cast("int")).over(past).alias("n_fit"))
    split = (F.when(F.col("pos") > F.col("train_size"), "test")
             .when(F.col("pos") > F.col("train_size") - val_weeks, "val"))
    test = s.withColumn("split", split).where(
        F.col("split").isNotNull() & (F.col("pos") <= F.col("train_size") + horizon)
        & F.col("_full") & (F.col("n_fit") >= 2 * p))
    out = test.select(*keys, "date", "pos", "y", "split", solver(p)("m").alias("beta"), *xc)
    pred = predict(F.col("beta"), xc)
    return out.select(*keys, F.lit(model).alias("model"), "date", F.col("y").alias("actual"),
                      (F.expm1(pred) if log_target else pred).alias("forecast"), "beta", "pos", "split")


def _arx_rows(series: DataFrame, keys: list[str], train_frac: float, season: int, exog: list[str], log_target: bool):
    from tillcast.functions.dates import is_holiday_week
    from tillcast.operators.forecast import with_positions
    s = with_positions(series, keys, train_frac)
    s = s.withColumn("_t", _log(F.col("y")) if log_target else F.col("y"))
    w = Window.partitionBy(*keys).orderBy("date")
    xs = [F.lit(1.0), F.lag("_t", 1).over(w), F.lag("_t", 2).over(w), F.lag("_t", season).over(w),
          is_holiday_week("date").cast("double"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in exog]]
    return s, xs, F.lag("_t", max(2, season)).over(w).isNotNull()


def arx_walk_forward(series: DataFrame, horizon: int = 8, train_frac: float = 0.8, season: int = 52,
                     keys: list[str] = ("level", "store"), exog: list[str] = (), log_target: bool = False,
                     model: str = "arx", val_weeks: int = 0) -> DataFrame:
    """AR(2) + seasonal lag + holiday + ``exog`` columns, refit before every step on all earlier weeks.

    X'X and X'y at each step are running window sums (unbounded preceding .. -1),
    so the walk-forward refit costs one sorted pass per series; each test week
    is a one-step-ahead forecast from the fit on all weeks before it. The target and its
    lags are log1p(max(y, 0)) unless ``log_target`` is off; a null exogenous value counts
    as 0. With ``val_weeks``, the last so many train weeks are forecast as well and
    marked split = val, the test weeks split = test.
    """
    keys = list(keys)
    s, xs, complete = _arx_rows(series, keys, train_frac, season, exog, log_target)
    out = _walk_forward(s, xs, complete, keys, horizon, val_weeks, log_target, model)
    return out.drop("beta", "pos", *([] if val_weeks else ["split"]))


def arx_fit(series: DataFrame, horizon: int = 8, train_frac: float = 0.8, season: int = 52, keys: list[str] = ("level", "store"),
            exog: list[str] = (), log_target: bool = False, model: str = "arx") -> DataFrame:
    """Model table of ``arx_walk_forward``: one row a series and test week, whose date is the version."""
    keys = list(keys)
    s, xs, complete = _arx_rows(series, keys, train_frac, season, exog, log_target)
    out = _walk_forward(s, xs, complete, keys, horizon, 0, log_target, model)
    params = F.create_map(F.lit("season"), F.lit(str(season)), F.lit("log_target"), F.lit(str(log_target).lower()))
    return out.select(*keys, "model", F.col("date").cast("string").alias("version"), params.alias("params"), F.col("beta").alias("coef"))


def arx_score(series: DataFrame, table: DataFrame, train_frac: float = 0.8, season: int = 52, keys: list[str] = ("level", "store"),
              exog: list[str] = (), log_target: bool = False) -> DataFrame:
    """One-step forecasts of the weeks that a model table has a version for."""
    keys = list(keys)
    s, xs, _ = _arx_rows(series, keys, train_frac, season, exog, log_target)
    s = s.select(*keys, "date", "y", *[x.alias(f"x{i}") for i, x in enumerate(xs)])
    beta = table.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "model", F.to_date("version").alias("_date"), "coef")
    near = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    pred = predict(F.col("coef"), [F.col(f"x{i}") for i in range(len(xs))])
    return s.join(beta, [*near, F.col("date") == F.col("_date")]).select(
        *keys, "model", "date", F.col("y").alias("actual"), (F.expm1(pred) if log_target else pred).alias("forecast"))


def innovations(series: DataFrame, order: int = 12, keys: list[str] = ("level", "store"), val_weeks: int = 0) -> DataFrame:
    """series (with pos, train_size and ``_t``) with ``_e``: what a long autoregression leaves of ``_t``.

    The autoregression of ``order`` lags is fitted once per series by grouped normal
    equations, on the train weeks before the last ``val_weeks`` only, so that a forecast week
    never enters it; its residuals go on through the weeks after. Null in the first
    ``order`` weeks, and throughout a series without a fit.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    lags = [F.lit(1.0), *[F.lag("_t", k).over(w) for k in range(1, order + 1)]]
    s = series.select("*", *[x.alias(f"_l{i}") for i, x in enumerate(lags)])
    lc = [F.col(f"_l{i}") for i in range(order + 1)]
    fit = s.where((F.col("pos") <= F.col("train_size") - val_weeks) & F.col(f"_l{order}").isNotNull())
    mom = fit.groupBy(*keys).agg(F.array(*[F.sum(c) for c in moment_terms(lc, F.col("_t"))]).alias("m"))
    beta = mom.select(*[F.col(k).alias(f"_b_{k}") for k in keys], solver(order + 1)("m").alias("_beta"))
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    rest = F.when(F.col(f"_l{order}").isNotNull(), F.col("_t") - predict(F.col("_beta"), lc))
    return s.join(beta, on, "left").select(*[F.col(c) for c in series.columns], rest.alias("_e"))


def arma_walk_forward(series: DataFrame, horizon: int = 8, train_frac: float = 0.8, season: int | None = 52, ar: int = 2, ma: int = 1,
                      long_order: int = 12, keys: list[str] = ("level", "store"), exog: list[str] = (), holiday: bool = True,
                      log_target: bool = False, model: str = "arma", val_weeks: int = 0, with_beta: bool = False) -> DataFrame:
    """``arx_walk_forward`` with moving-average terms, by two-stage least squares.

    Stage one leaves the innovations of a long autoregression (``innovations``); stage two
    regresses on ``ar`` lags, the seasonal lag (none: null), ``ma`` lagged innovations,
    holiday and exogenous columns by the same running moments, refit before every step.
    ``with_beta`` adds the coefficients: intercept, lags, season, innovations, holiday, exogenous.
    With ``val_weeks`` there are pos and split as well.
    """
    from tillcast.functions.dates import is_holiday_week
    from tillcast.operators.forecast import with_positions
    keys = list(keys)
    s = with_positions(series, keys, train_frac)
    s = s.withColumn("_t", _log(F.col("y")) if log_target else F.col("y"))
    s = innovations(s, long_order, keys, val_weeks)
    w = Window.partitionBy(*keys).orderBy("date")
    back = [*range(1, ar + 1), *([season] if season else [])]
    xs = [F.lit(1.0), *[F.lag("_t", k).over(w) for k in back], *[F.lag("_e", k).over(w) for k in range(1, ma + 1)],
          *([is_holiday_week("date").cast("double")] if holiday else []),
          *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in exog]]
    complete = F.lag("_t", max([1, *back])).over(w).isNotNull()
    if ma:
        complete &= F.lag("_e", ma).over(w).isNotNull()
    out = _walk_forward(s, xs, complete, keys, horizon, val_weeks, log_target, model)
    return out.drop(*([] if val_weeks else ["pos", "split"]), *([] if with_beta else ["beta"]))


def tuned_arma(series: DataFrame, folds: DataFrame, settings: list[dict], val_weeks: int, horizon: int = 8,
               keys: list[str] = ("level", "store"), exog: list[str] = (), model: str = "arma") -> tuple[DataFrame, DataFrame]:
    """Test forecasts with the setting of least mean RMSE over the folds, and the losses (keys, setting, fold, ...).

    Running moments refit a setting before every week of all folds in one pass, so that
    each is scored on whole folds at once and nothing is left for smaller budgets to save.
    ``settings`` hold season, ar, ma and log; ``folds`` (keys, fold, start, stop) lie in the
    last ``val_weeks`` train weeks. A setting that lacks a forecast in a fold ranks last.
    """
    from tillcast.operators.tuning import rank_losses
    from tillcast.session import written
    keys, out = list(keys), None
    for k, p in enumerate(settings):
        fc = arma_walk_forward(series, horizon, season=p["season"], ar=p.get("ar", 2), ma=p.get("ma", 0), keys=keys, exog=exog,
                               log_target=bool(p.get("log", 1)), model=model, val_weeks=val_weeks).withColumn("setting", F.lit(k))
        out = fc if out is None else out.unionByName(fc)
    out = written(out)
    val = out.where("split = 'val'")
    ranges = folds.select(*[F.col(k).alias(f"_f_{k}") for k in keys], "fold", "start", "stop")
    inside = [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys]
    met = val.join(ranges, [*inside, F.col("pos") > F.col("start"), F.col("pos") <= F.col("stop")])
    e2 = F.avg(F.pow(F.col("actual") - F.col("forecast"), 2))
    whole = F.count("forecast") == F.first(F.col("stop") - F.col("start"))
    losses = rank_losses(met.groupBy(*keys, "setting", "fold").agg(F.when(whole, F.sqrt(e2)).alias("loss")), 1, keys)
    best = losses.where("survives").select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("setting").alias("_setting")).distinct()
    mine = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]
    test = out.where("split = 'test'").join(best, [*mine, F.col("setting") == F.col("_setting")])
    return test.select(*keys, "model", "date", "actual", "forecast", "setting"), losses


def grid_search_arx(series: DataFrame, seasons=(4, 13, 26, 52), logs=(True, False), horizon: int = 8,
                    val_weeks: int = 16, keys=("level", "store"), exog: list[str] = ()) -> DataFrame:
    """Grid over ARX settings. Each is refit before every validation week (the last
    ``val_weeks`` of the train part); the setting of least validation RMSE is chosen per
    series. One row a series and setting: validation RMSE, test RMSE and R2, chosen or
    not, and the setting as a map column."""
    keys = list(keys)
    out = None
    for season in seasons:
        for log in logs:
            fc = arx_walk_forward(series, horizon=horizon, season=season, keys=keys, exog=exog, log_target=log,
                                  model=f"arx_s{season}_{'log' if log else 'raw'}", val_weeks=val_weeks)
            fc = fc.withColumn("params", F.create_map(F.lit("season"), F.lit(str(season)),
                                                      F.lit("log_target"), F.lit(str(log).lower())))
            out = fc if out is None else out.unionByName(fc)
    e2 = F.pow(F.col("actual") - F.col("forecast"), 2)
    test = F.col("split") == "test"
    sst = F.count(F.when(test, F.col("actual"))) * F.var_pop(F.when(test, F.col("actual")))
    m = out.groupBy(*keys, "model").agg(
        F.first("params").alias("params"), F.sqrt(F.avg(F.when(~test, e2))).alias("val_rmse"),
        F.sqrt(F.avg(F.when(test, e2))).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(F.when(test, e2)), F.when(sst != 0, sst))).alias("r2"))
    best = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("val_rmse"), "model")
    return m.withColumn("chosen", F.row_number().over(best) == 1)


def hinge_terms(t: np.ndarray, week: np.ndarray, holiday: np.ndarray, breaks: np.ndarray, order: int) -> np.ndarray:
    """Columns: intercept, trend, yearly sines and cosines, holiday, then a hinge at every candidate break."""
    yearly = [f(2 * np.pi * k / 52.1775 * week) for k in range(1, order + 1) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(len(t)), t, *yearly, holiday, *[np.maximum(t - c, 0) for c in breaks]])


def lasso(g: np.ndarray, c: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 1000) -> np.ndarray:
    """b that minimises b'gb / 2 - c'b + penalty * sum(weight |b|), on the moments alone; weight 0: free.

    Terms enter one at a time, the one that breaks its condition most first. The active
    ones are solved for their signs at once, and a step stops where a term changes sign if
    the value is least there; that term leaves. Ends when all conditions hold.
    """
    b = np.zeros(len(c)) if start is None else start.copy()
    cost, live = penalty * weight, np.diag(g) > 0
    slack = 1e-11 * max(1.0, float(np.abs(c).max(initial=0)))

    def value(v: np.ndarray) -> float:
        return float(v @ g @ v / 2 - c @ v + cost @ np.abs(v))

    for _ in range(rounds):
        slope, sign = c - g @ b, np.sign(b)
        active = live & ((b != 0) | (cost == 0))
        if not (active & (np.abs(slope - cost * sign) > slack)).any():
            over = np.where(live & ~active, np.abs(slope) - cost, -np.inf)
            j = int(over.argmax())
            if over[j] <= slack:
                break
            active[j], sign[j] = True, np.sign(slope[j])
        a = np.flatnonzero(active)
        step = np.linalg.lstsq(g[np.ix_(a, a)], c[a] - cost[a] * sign[a], rcond=1e-13)[0] - b[a]
        best, now = None, value(b)
        for k in [-1, *np.flatnonzero((b[a] * (b[a] + step) < 0) & (cost[a] > 0))]:
            v = b.copy()
            v[a] += step * (1.0 if k < 0 else -b[a[k]] / step[k])
            if k >= 0:
                v[a[k]] = 0.0
            if best is None or value(v) < best[0]:
                best = value(v), v
        if best[0] >= now and not (best[1] != b).any():
            break
        if best[0] > now - 1e-15 * abs(now) and np.abs(best[1] - b).max() < 1e-14:
            break
        b = best[1]
    return b


def lasso_path(x: np.ndarray, y: np.ndarray, n_free: int, steps: int = 30, ratio: float = 1e-3):
    """(penalty, coefficients, residual sum) from the penalty that keeps no break down to ``ratio`` of it.

    The first ``n_free`` columns are not penalised and are projected out, so that only the
    breaks are iterated; those are scaled to unit norm after the projection.
    """
    free, some = x[:, :n_free], x[:, n_free:]
    clean = lambda v: v - free @ (np.linalg.pinv(free) @ v)
    z, r = clean(some), clean(y)
    norm = np.sqrt((z ** 2).sum(axis=0))
    norm = np.where(norm > 1e-9 * max(1.0, np.sqrt(len(y))), norm, np.inf)  # a break that the rest spans stays out
    z = z / norm
    g, c = z.T @ z, z.T @ r
    top = float(np.abs(c).max(initial=0))
    b = np.zeros(some.shape[1])
    for penalty in top * np.geomspace(1, ratio, steps):
        b = lasso(g, c, np.ones(len(c)), penalty, b)
        coef = b / norm
        whole = np.concatenate((np.linalg.pinv(free) @ (y - some @ coef), coef))
        yield penalty, whole, float(((y - x @ whole) ** 2).sum()), norm


def trend_breaks(series: DataFrame, horizon: int = 20, train_frac: float = 0.8, n_breaks: int = 25, span: float = 0.8, order: int = 3,
                 keys: list[str] = ("level", "store"), log_target: bool = True, steps: int = 30) -> tuple[DataFrame, DataFrame]:
    """Trend with chosen breaks: test forecasts, and the terms of each series.

    ``n_breaks`` candidates lie evenly in the first ``span`` of the train weeks. Of a path of
    penalties the one of least BIC is taken (n log(rss / n) + log(n) times the terms that are
    not zero). Terms: (keys, term, at, coef, gradient, penalty): gradient is a scaled break's
    product with the residual, which is the signed penalty where coef is not 0 and no larger
    elsewhere. Free terms have a null gradient. A series of fewer train weeks than twice its
    free terms has no rows.
    """
    from tillcast.functions.dates import is_holiday_week, iso_week
    from tillcast.operators.forecast import with_positions
    keys = list(keys)
    s = with_positions(series, keys, train_frac).where(F.col("pos") <= F.col("train_size") + horizon).select(
        *keys, "date", "pos", "n", "train_size", F.col("y").cast("double").alias("y"), iso_week("date").cast("double").alias("week"), is_holiday_week("date").cast("double").alias("holiday"))
    kinds = [s.schema[k] for k in keys]
    names = ["intercept", "trend", *[f"{f}{k}" for k in range(1, order + 1) for f in ("sin", "cos")], "holiday"]
    schema = T.StructType(kinds).add("term", "string").add("at", "double").add("coef", "double").add("gradient", "double").add(
        "penalty", "double").add("date", "date").add("actual", "double").add("forecast", "double")

    def run(table):
        import pyarrow as pa
        table = table.sort_by("pos")
        y, pos, week, holiday = (table.column(c).to_numpy().astype(float) for c in ("y", "pos", "week", "holiday"))
        size, n = table.column("train_size")[0].as_py(), table.column("n")[0].as_py()
        t = pos / max(size, 1)
        breaks = span * np.arange(1, n_breaks + 1) / (n_breaks + 1)
        x = hinge_terms(t, week, holiday, breaks, order)
        target = np.log1p(np.maximum(y, 0)) if log_target else y
        past, free = pos <= size, len(names)
        terms: list[tuple] = []
        ahead: list[tuple] = []
        if size >= 2 * free:
            best = None
            for penalty, coef, rss, norm in lasso_path(x[past], target[past], free, steps):
                bic = size * np.log(max(rss, 1e-300) / size) + np.log(size) * (free + int((coef[free:] != 0).sum()))
                if best is None or bic < best[0] - 1e-9:
                    best = bic, penalty, coef, norm
            _, penalty, coef, norm = best
            pull = (x[past][:, free:] / norm).T @ (target[past] - x[past] @ coef)
            terms = [(m, None, float(c), None, float(penalty)) for m, c in zip(names, coef)]
            terms += [("break", float(a), float(c), float(g), float(penalty)) for a, c, g in zip(breaks, coef[free:], pull)]
            pred = x[~past] @ coef
            if n - size >= horizon:
                ahead = list(zip(table.column("date").filter(pa.array(~past)).to_pylist(), y[~past].tolist(),
                                 (np.expm1(np.minimum(pred, 700)) if log_target else pred).tolist()))
        m = len(terms) + len(ahead)
        cols = [[*c, *[None] * len(ahead)] for c in (zip(*terms) if terms else [()] * 5)]
        cols += [[*[None] * len(terms), *c] for c in (zip(*ahead) if ahead else [()] * 3)]
        kind = [pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.date32(), pa.float64(), pa.float64()]
        keyed = {k: pa.array([table.column(k)[0].as_py()] * m, table.schema.field(k).type) for k in keys}
        return pa.table({**keyed, **{f.name: pa.array(c, p) for f, c, p in zip(schema.fields[len(keys):], cols, kind)}})

    from tillcast.session import written
    both = written(s.groupBy(*keys).applyInArrow(run, schema))
    forecasts = both.where("term is null").select(*keys, F.lit("trend_breaks").alias("model"), "date", "actual", "forecast")
    return forecasts, both.where("term is not null").select(*keys, "term", "at", "coef", "gradient", "penalty")
