"""Forecasting building blocks: level series on a weekly spine, positions and splits,
lag/rolling feature tables, naive baselines, validation folds, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.dates import iso_week
from tillcast.operators.features import category_codes, lags, shifted_rolling, store_dept_week
from tillcast.operators.prepare import weekly_spine, with_defaults
from tillcast.session import written

LEVEL = ["level", "store"]


def level_series(df: DataFrame, value: str, chain: bool = True) -> DataFrame:
    """(level, store, date, y): store totals and the chain total (store null), each on a
    regular weekly spine with absent weeks 0. The chain is reduced to one row per
    date before any window, so it never becomes one huge partition. Store weeks are
    written once; spines and the chain are read from them."""
    st = written(df.groupBy("store", "date").agg(F.sum(value).alias("y")))
    st = weekly_spine(st, ["store"]).join(st, ["store", "date"], "left")
    out = st.select(F.lit("store").alias("level"), "store", "date", F.coalesce("y", F.lit(0.0)).alias("y"))
    if chain:
        ch = st.groupBy("date").agg(F.sum("y").alias("y"))
        ch = weekly_spine(ch, []).join(ch, ["date"], "left")
        out = out.unionByName(ch.select(F.lit("chain").alias("level"), F.lit(None).cast("int").alias("store"),
                                        "date", F.coalesce("y", F.lit(0.0)).alias("y")))
    return out


def with_positions(series: DataFrame, keys: list[str] = LEVEL, train_frac: float = 0.8) -> DataFrame:
    """1-based position, series length and train size floor(train_frac * n) per series."""
    w = Window.partitionBy(*keys).orderBy("date")
    return (series.withColumn("pos", F.row_number().over(w))
                  .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
                  .withColumn("train_size", F.floor(F.col("n") * F.lit(train_frac)).cast("int")))


def train_test_split(series: DataFrame, keys: list[str] = LEVEL, train_frac: float = 0.8) -> DataFrame:
    s = with_positions(series, keys, train_frac)
    return s.withColumn("split", F.when(F.col("pos") <= F.col("train_size"), "train").otherwise("test"))


def inner_split(series: DataFrame, keys: list[str] = LEVEL, train_frac: float = 0.8) -> DataFrame:
    """train / val / test by position: the train part is split again at ``train_frac``."""
    s = with_positions(series, keys, train_frac)
    s = s.withColumn("inner_size", F.floor(F.col("train_size") * F.lit(train_frac)).cast("int"))
    return s.withColumn("split", F.when(F.col("pos") <= F.col("inner_size"), "train")
                        .when(F.col("pos") <= F.col("train_size"), "val").otherwise("test"))


def naive_short(series: DataFrame, horizon: int = 8, train_frac: float = 0.8, min_train: int = 52,
                keys: list[str] = LEVEL) -> DataFrame:
    """The last ``horizon`` train values laid over the first test weeks, for series with
    more than ``min_train`` train weeks and a test part of ``horizon`` weeks or more."""
    s = with_positions(series, keys, train_frac)
    w = Window.partitionBy(*keys).orderBy("date")
    s = s.withColumn("f", F.lag("y", horizon).over(w))
    t = s.where((F.col("pos") > F.col("train_size")) & (F.col("pos") <= F.col("train_size") + horizon)
                & (F.col("n") - F.col("train_size") >= horizon) & (F.col("train_size") > min_train))
    return t.select(*keys, F.lit("naive_short").alias("model"), "date", F.col("y").alias("actual"), F.col("f").alias("forecast"))


def apply_eligibility(fc: DataFrame, series: DataFrame, rule: str, horizon: int = 8, keys: list[str] = LEVEL) -> DataFrame:
    """The forecast rows of series that pass ``rule``, a flag of ``eligible_series``."""
    ok = eligible_series(series, horizon, keys).where(F.col(rule)).select(*[F.col(k).alias(f"_e_{k}") for k in keys])
    return fc.join(ok, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys], "left_semi")


def chain_train_totals(series: DataFrame, train_frac: float = 0.8) -> DataFrame:
    """(date, train_total): the store series' train parts summed by week."""
    s = with_positions(series.where(F.col("level") == "store"), LEVEL, train_frac)
    return s.where(F.col("pos") <= F.col("train_size")).groupBy("date").agg(F.sum("y").alias("train_total"))


def naive_forecasts(series: DataFrame, horizon: int = 20, season: int = 52,
                    train_frac: float = 0.8, keys: list[str] = LEVEL) -> DataFrame:
    """Long rows (level, store, model, date, actual, forecast) over the first ``horizon``
    test weeks of series whose test part holds at least ``horizon`` weeks.

    naive_tail: the last ``horizon`` train values laid over the horizon (left edge
    padding when the train part is shorter) = the value ``horizon`` weeks back, or
    the first value. seasonal_naive: the value ``season`` weeks back.
    """
    s = with_positions(series, keys, train_frac)
    w = Window.partitionBy(*keys).orderBy("date")
    first = F.first("y").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.select("*", F.coalesce(F.lag("y", horizon).over(w), first).alias("naive_tail"),
                 F.lag("y", season).over(w).alias("seasonal_naive"))
    test = ((F.col("pos") > F.col("train_size")) & (F.col("pos") <= F.col("train_size") + horizon)
            & (F.col("n") - F.col("train_size") >= horizon))
    t = s.where(test)
    return t.select(*keys, "date", F.col("y").alias("actual"),
                    F.explode(F.array(F.struct(F.lit("naive_tail").alias("model"), F.col("naive_tail").alias("f")),
                                      F.struct(F.lit("seasonal_naive").alias("model"),
                                               F.col("seasonal_naive").alias("f")))).alias("m")) \
            .select(*keys, F.col("m.model").alias("model"), "date", "actual", F.col("m.f").alias("forecast"))


def global_features(cleaned: DataFrame) -> DataFrame:
    """Store-dept-week table + calendar + lags 1, 2 + shifted rolling means 4, 12
    (min 1 row, inside each series) + dense store/dept codes; rows need both lags."""
    t = store_dept_week(cleaned)
    t = lags(t, "weekly_sales", [1, 2])
    t = shifted_rolling(t, "weekly_sales", [4, 12])
    t = category_codes(t, ["store", "dept"])
    return t.dropna(subset=["lag_1", "lag_2"])


def long_features(series: DataFrame, keys: list[str] = LEVEL) -> DataFrame:
    """Lags 1, 2, 52, full shifted rolling means 4, 12, 52, calendar; complete rows only."""
    t = lags(series, "y", [1, 2, 52], keys)
    t = shifted_rolling(t, "y", [4, 12, 52], keys, full=True, prefix="roll_mean")
    t = t.select("*", iso_week("date").alias("weekofyear"), F.month("date").cast("int").alias("month"),
                 F.year("date").cast("int").alias("year"))
    return t.dropna(subset=["lag_1", "lag_2", "lag_52", "roll_mean_4", "roll_mean_12", "roll_mean_52"])


def short_features(series: DataFrame, exog: DataFrame | None = None, keys: list[str] = LEVEL,
                   exog_cols: list[str] = ()) -> DataFrame:
    """Calendar, time index, lags 1, 2, 4, 8, full shifted rolling mean/std 4, 8, exogenous
    columns (left join on the series key and date); complete rows only. A column of
    ``exog_cols`` that ``exog`` does not have is 0 in every row."""
    from tillcast.operators.features import calendar_features
    t = calendar_features(series, keys)
    t = t.withColumn("is_year_start", F.col("is_year_start").cast("int")) \
         .withColumn("is_year_end", F.col("is_year_end").cast("int"))
    t = lags(t, "y", [1, 2, 4, 8], keys)
    t = shifted_rolling(t, "y", [4, 8], keys, full=True, prefix="rolling_mean")
    t = shifted_rolling(t, "y", [4, 8], keys, stat="std", full=True, prefix="rolling")
    need = ["lag_1", "lag_2", "lag_4", "lag_8", "rolling_mean_4", "rolling_mean_8",
            "rolling_std_4", "rolling_std_8"]
    if exog is not None:
        t = t.join(exog, [*keys, "date"], "left")
        need += [c for c in exog.columns if c not in (*keys, "date")]
    return with_defaults(t, exog_cols).dropna(subset=need)


def walk_forward_folds(series: DataFrame, horizon: int = 20, start_frac: float = 0.7,
                       keys: list[str] = LEVEL) -> DataFrame:
    """Expanding-window folds: start = int(0.7 n), step = horizon, validation = next horizon rows.

    Output (keys, fold, date, role) with role train/val: one row per series row per fold
    it takes part in; the fold list per series comes from ``sequence``, not a join.
    """
    s = with_positions(series, keys, start_frac)
    s = s.where(F.col("n") - horizon - 1 >= F.col("train_size"))
    s = s.withColumn("starts", F.sequence(F.col("train_size"), F.col("n") - horizon - 1, F.lit(horizon)))
    f = s.select(*keys, "date", "pos", F.posexplode("starts").alias("fold", "start"))
    role = F.when(F.col("pos") <= F.col("start"), "train").when(F.col("pos") <= F.col("start") + horizon, "val")
    return f.withColumn("role", role).where(F.col("role").isNotNull()).select(*keys, "fold", "date", "role")


def position_folds(series: DataFrame, min_train: int = 40, val: int = 8, step: int = 8,
                   keys: list[str] = LEVEL) -> DataFrame:
    """Folds with train = first min_train + k*step rows, validation = next ``val`` rows."""
    s = with_positions(series, keys)
    s = s.where(F.col("n") >= min_train + val)
    s = s.withColumn("starts", F.sequence(F.lit(min_train), F.col("n") - val, F.lit(step)))
    f = s.select(*keys, "date", "pos", F.posexplode("starts").alias("fold", "start"))
    role = F.when(F.col("pos") <= F.col("start"), "train").when(F.col("pos") <= F.col("start") + val, "val")
    return f.withColumn("role", role).where(F.col("role").isNotNull()).select(*keys, "fold", "date", "role")


def rolling_origin_cuts(df: DataFrame, n_folds: int = 4, horizon_weeks: int = 12,
                        buffer_weeks: int = 26) -> list:
    """Fold cut dates evenly spaced from min + buffer to max - horizon (a few driver scalars)."""
    import datetime as dt
    row = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    start = row["lo"] + dt.timedelta(weeks=buffer_weeks)
    end = row["hi"] - dt.timedelta(weeks=horizon_weeks)
    if n_folds == 1:
        return [start]
    span = (end - start) / (n_folds - 1)
    return [start + span * i for i in range(n_folds)]


def rolling_origin_folds(df: DataFrame, n_folds: int = 4, horizon_weeks: int = 12,
                         buffer_weeks: int = 26) -> DataFrame:
    """Per fold: train = date <= cut, validation = cut < date <= cut + horizon; fold roles are
    date predicates, so each fold filter can reach the scan as a date range."""
    cuts = rolling_origin_cuts(df, n_folds, horizon_weeks, buffer_weeks)
    d = F.col("date")
    fold = F.posexplode(F.array(*[F.lit(c) for c in cuts])).alias("fold", "cut")
    return (df.select("date").distinct().select("date", fold)
            .withColumn("role", F.when(d <= F.col("cut"), "train")
                        .when(d <= F.date_add("cut", 7 * horizon_weeks), "val"))
            .where(F.col("role").isNotNull()).select("fold", "cut", "date", "role"))


def eligible_series(series: DataFrame, horizon: int = 8, keys: list[str] = LEVEL) -> DataFrame:
    """Length checks that decide which series each model may run on."""
    n = F.count(F.lit(1))
    t = F.floor(n * F.lit(0.8)).cast("int")
    return series.groupBy(*keys).agg(n.alias("n_weeks"), t.alias("train_size")).select(
        *keys, "n_weeks", "train_size",
        (F.col("n_weeks") >= 3 * horizon).alias("enough_weeks"),
        (F.col("n_weeks") >= 40).alias("arx_ok"),
        ((F.col("train_size") >= 12) & (F.least(F.col("n_weeks") - F.col("train_size"), F.lit(horizon)) >= 4))
        .alias("split_ok"),
        ((F.col("n_weeks") - F.col("train_size") >= horizon) & (F.col("train_size") > 52)).alias("naive_ok"))
