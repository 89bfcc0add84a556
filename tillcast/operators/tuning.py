"""Choice of settings by successive halving on time-ordered folds.

Each rung is one distributed job: a task is a series, a setting and a fold, and gives a
loss. A window ranks a series' settings by mean loss; one in ``keep`` goes on to the next
rung, where each is given a larger budget.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import written

LEVEL = ["level", "store"]


def fold_ranges(series: DataFrame, horizon: int, first: Column | int, size: Column | str = "train_size", step: int | None = None,
                keys: list[str] = LEVEL) -> DataFrame:
    """(keys, fold, start, stop), one row a fold: train on positions to start, validate on those to stop.

    ``series`` has ``size``, the number of positions that folds may use, and the fold
    starts are ``first``, ``first`` + step, ... while a whole horizon of them is left.
    """
    keys = list(keys)
    one = series.select(*keys, (F.col(size) if isinstance(size, str) else size).cast("int").alias("size"),
                        (first if isinstance(first, Column) else F.lit(first)).cast("int").alias("first")).distinct()
    one = one.where((F.col("first") > 0) & (F.col("first") + horizon <= F.col("size")))
    starts = F.sequence(F.col("first"), F.col("size") - horizon, F.lit(step or horizon))
    return one.select(*keys, F.posexplode(starts).alias("fold", "start")).select(
        *keys, "fold", "start", (F.col("start") + horizon).alias("stop"))


def walk_forward_ranges(series: DataFrame, horizon: int = 20, start_frac: float = 0.7, keys: list[str] = LEVEL) -> DataFrame:
    """Expanding folds inside the train part: the first trains on ``start_frac`` of it, steps of a horizon."""
    return fold_ranges(series, horizon, F.floor(F.col("train_size") * F.lit(start_frac)), keys=keys)


def position_ranges(series: DataFrame, min_train: int = 40, val: int = 8, step: int = 8, keys: list[str] = LEVEL) -> DataFrame:
    """Folds inside the train part: train on the first min_train + k * step positions."""
    return fold_ranges(series, val, min_train, step=step, keys=keys)


def last_folds(folds: DataFrame, n: int, keys: list[str] = LEVEL) -> DataFrame:
    """The ``n`` latest folds of each series, numbered as before."""
    w = Window.partitionBy(*keys).orderBy(F.desc("start"))
    return folds.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def rank_losses(losses: DataFrame, keep: int, keys: list[str] = LEVEL) -> DataFrame:
    """losses with the mean over a setting's folds, its rank in the series, and whether it is among the first ``keep``.

    A setting with a fold without a loss ranks last; ties go to the smaller setting.
    """
    keys = list(keys)
    mean = F.when(F.count("loss").over(of := Window.partitionBy(*keys, "setting")) == F.count(F.lit(1)).over(of), F.avg("loss").over(of))
    ranked = losses.withColumn("mean_loss", mean)
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("mean_loss"), "setting")
    return ranked.withColumn("rank", F.dense_rank().over(w)).withColumn("survives", F.col("rank") <= keep)


def _task(keys: list[str], settings: list[dict], loss, budget: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        k, fold, start = (group.column(c)[0].as_py() for c in ("_setting", "_fold", "_start"))
        got = loss(group, settings[k], budget, start)
        got = got if got is not None and math.isfinite(got) else None
        return pa.table({**{c: group.column(c).slice(0, 1) for c in keys}, "setting": pa.array([k], pa.int32()),
                         "fold": pa.array([fold], pa.int32()), "loss": pa.array([got], pa.float64())})
    return run


def halving(rows: DataFrame, folds: DataFrame, settings: list[dict], loss: Callable[[pa.Table, dict, int, int], float | None],
            budgets: list[int], keep: int = 3, keys: list[str] = LEVEL) -> DataFrame:
    """Rung table (keys, rung, budget, setting, fold, loss, mean_loss, rank, survives).

    ``rows`` has the keys and pos, one row a week. ``loss(table, params, budget, start)``
    gets a series' rows up to the fold's end in order of pos, and is None where it cannot
    fit. Rung r ranks ceil(len(settings) / keep ** r) settings a series and passes one
    in ``keep`` on; the last passes one on, the choice. Series without a fold are left out.
    """
    keys = list(keys)
    schema = T.StructType([rows.schema[k] for k in keys]).add("setting", "integer").add("fold", "integer").add("loss", "double")
    table, alive = None, None
    for rung, budget in enumerate(budgets):
        if alive is None:
            tasks = folds.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))))
        else:
            same = [F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in keys]
            tasks = folds.join(alive.select(*[F.col(k).alias(f"_a_{k}") for k in keys], "setting"), same)
        tasks = tasks.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("setting").cast("int").alias("_setting"),
                             F.col("fold").cast("int").alias("_fold"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
        on = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
        held = rows.join(tasks, [*on, F.col("pos") <= F.col("_stop")])

        losses = written(held.groupBy(*keys, "_setting", "_fold").applyInArrow(_task(keys, settings, loss, budget), schema))
        left = 1 if rung + 1 == len(budgets) else math.ceil(len(settings) / keep ** (rung + 1))
        ranked = rank_losses(losses, left, keys)
        alive = ranked.where("survives").select(*keys, "setting").distinct()
        one = ranked.select(*keys, F.lit(rung).alias("rung"), F.lit(budget).alias("budget"), "setting", "fold", "loss", "mean_loss", "rank", "survives")
        table = one if table is None else table.unionByName(one)
    return table


def choice(rungs: DataFrame, keys: list[str] = LEVEL) -> DataFrame:
    """(keys, setting): what the last rung passed on."""
    last = rungs.agg(F.max("rung")).first()[0]
    return rungs.where((F.col("rung") == F.lit(last)) & F.col("survives")).select(*keys, "setting").distinct()
