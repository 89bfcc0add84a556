"""Boosted regression trees, one model per series, fitted in grouped Arrow calls.

A group is one series' weeks, a few hundred rows, so a model is numpy work in one
task and series are spread over the cluster. Trees split on histograms: a column of up
to ``bins`` distinct values is split exactly, a longer one at its quantiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# rounds, depth, step, rows, columns: as usual; min_leaf: rows of a leaf; l2: added to a leaf's weight; min_gain: halved loss a split must save
DEFAULTS = {"depth": 4, "step": 0.1, "rows": 1.0, "columns": 1.0, "min_leaf": 3, "l2": 1.0, "min_gain": 0.0, "log": 1, "bins": 64}


def random_settings(n: int, seed: int = 42) -> list[dict]:
    """``n`` settings drawn once from the ranges searched (step on a log scale); fixed by the seed."""
    r = np.random.default_rng(seed)
    return [{"depth": int(r.integers(2, 7)), "step": round(float(np.exp(r.uniform(np.log(0.03), np.log(0.3)))), 4),
             "rows": round(float(r.uniform(0.6, 1)), 2), "columns": round(float(r.uniform(0.6, 1)), 2), "min_leaf": int(r.integers(1, 11)),
             "min_gain": round(float(r.uniform(0, 0.02)), 4), "l2": round(float(r.uniform(0, 5)), 2), "log": int(r.integers(0, 2))} for _ in range(n)]


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Values v of ``column`` where a row goes left if it is v or less; the largest is none."""
    values = np.unique(column)[:-1]
    return values if len(values) < bins else np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))


class Boosted:
    """Squared-error boosting. A tree is three arrays over a full binary tree: column (-1: leaf), cut, value."""

    def __init__(self, params: dict, seed: int = 42):
        self.p = DEFAULTS | params
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.random = np.random.default_rng(seed)

    def _tree(self, codes: np.ndarray, cuts: list[np.ndarray], rest: np.ndarray):
        p, n, f = self.p, *codes.shape
        depth, width = int(p["depth"]), max(map(len, cuts)) + 1
        column, cut, value = np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1), np.zeros(2 ** (depth + 1) - 1)
        allowed = np.ones(f, bool)
        if p["columns"] < 1:
            allowed[self.random.permutation(f)[max(1, round(f * p["columns"])):]] = False
        here = np.zeros(n, np.int64)  # node of each row
        open_rows = np.arange(n)
        if p["rows"] < 1:
            open_rows = np.sort(self.random.permutation(n)[:max(1, round(n * p["rows"]))])
        for level in range(depth + 1):
            nodes, at = np.unique(here[open_rows], return_inverse=True)
            total, count = np.bincount(at, rest[open_rows]), np.bincount(at)
            value[nodes] = total / (count + p["l2"])
            if level == depth:
                break
            place = (at[:, None] * f + np.arange(f)) * width + codes[open_rows]
            size = len(nodes) * f * width
            left = np.bincount(place.ravel(), np.repeat(rest[open_rows], f), size).reshape(-1, f, width).cumsum(axis=2)[:, :, :-1]
            held = np.bincount(place.ravel(), minlength=size).reshape(-1, f, width).cumsum(axis=2)[:, :, :-1]
            other, others = total[:, None, None] - left, count[:, None, None] - held
            tiny = 1e-12  # a leaf without rows is never taken
            gain = left ** 2 / (held + p["l2"] + tiny) + other ** 2 / (others + p["l2"] + tiny) - (total ** 2 / (count + p["l2"]))[:, None, None]
            gain[(held < p["min_leaf"]) | (others < p["min_leaf"]) | ~allowed[None, :, None]] = -np.inf
            flat = gain.reshape(len(nodes), -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(len(nodes)), best] / 2 > max(p["min_gain"] * self.scale, 1e-12 * self.scale)
            if not good.any():
                break
            which, bound = best // (width - 1), best % (width - 1)
            column[nodes[good]] = which[good]
            cut[nodes[good]] = [cuts[c][b] for c, b in zip(which[good], bound[good])]
            stays = good[at]
            open_rows, at = open_rows[stays], at[stays]
            right = codes[open_rows, which[at]] > bound[at]
            here[open_rows] = 2 * here[open_rows] + 1 + right
        return column, cut, value

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        column, cut, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(int(self.p["depth"])):
            c = column[node]
            inner = c >= 0
            if not inner.any():
                break
            goes = 2 * node + 1 + (x[np.arange(len(x)), np.maximum(c, 0)] > cut[node])
            node = np.where(inner, goes, node)
        return value[node]

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int, val: tuple[np.ndarray, np.ndarray] | None = None, patience: int = 30) -> Boosted:
        """Boost for ``rounds`` trees; with ``val`` stop after ``patience`` rounds without gain there and keep the best number."""
        self.base = float(y.mean())
        self.scale = float(((y - self.base) ** 2).sum())
        cuts = [_cuts(x[:, j], int(self.p["bins"])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
        rest = y - self.base
        ahead = None if val is None else np.full(len(val[0]), self.base)
        best, best_at = np.inf, 0
        for k in range(rounds):
            tree = self._tree(codes, cuts, rest)
            tree = (tree[0], tree[1], tree[2] * self.p["step"])
            self.trees.append(tree)
            rest = rest - self._apply(tree, x)
            if val is not None:
                ahead = ahead + self._apply(tree, val[0])
                loss = float(((val[1] - ahead) ** 2).mean())
                if loss < best - 1e-12:
                    best, best_at = loss, k + 1
                elif k + 1 - best_at >= patience:
                    break
        if val is not None:
            self.trees = self.trees[:best_at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self._apply(tree, x)
        return out


def _matrix(table: pa.Table, features: list[str]) -> np.ndarray:
    return np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in features], axis=1)


def _to(y: np.ndarray, log: bool) -> np.ndarray:
    return np.log1p(np.maximum(y, 0)) if log else y


def _back(y: np.ndarray, log: bool) -> np.ndarray:
    return np.expm1(np.minimum(y, 700)) if log else y


def tree_loss(features: list[str], target: str = "y") -> Callable[[pa.Table, dict, int, int], float | None]:
    """Loss for ``tuning.halving``: RMSE over the weeks after ``start`` of ``budget`` trees fitted on those up to it."""
    def loss(table: pa.Table, params: dict, budget: int, start: int) -> float | None:
        x, y, past = _matrix(table, features), table.column(target).to_numpy(), table.column("pos").to_numpy() <= start
        if past.sum() < 10 or past.all():
            return None
        log = bool(params.get("log", DEFAULTS["log"]))
        model = Boosted(params).fit(x[past], _to(y[past], log), budget)
        return float(np.sqrt(((y[~past] - _back(model.predict(x[~past]), log)) ** 2).mean()))
    return loss


def series_trees(rows: DataFrame, chosen: DataFrame, settings: list[dict], features: list[str], model: str, horizon: int,
                 keys: list[str] = ("level", "store"), rounds: int = 400, patience: int = 30, target: str = "y") -> DataFrame:
    """(keys, model, date, actual, forecast, setting, rounds): one model per series with its chosen setting.

    ``rows`` has pos and train_size (``with_positions``) and complete features. The number
    of trees is where the loss on the last ``horizon`` train weeks is least, at most
    ``rounds``; the model is then fitted on all train weeks with that number and forecasts
    the first ``horizon`` weeks after them. Series of fewer than ten such train rows or
    without test rows have no forecast.
    """
    keys = list(keys)
    near = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]
    picked = chosen.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("setting").alias("_setting"))
    used = rows.where(F.col("pos") <= F.col("train_size") + horizon).join(picked, near).select(
        *keys, "_setting", "date", "pos", "train_size", target, *features)
    out = T.StructType([rows.schema[k] for k in keys]).add("model", "string").add("date", "date").add("actual", "double").add(
        "forecast", "double").add("setting", "integer").add("rounds", "integer")

    def run(table: pa.Table) -> pa.Table:
        x, y, pos = _matrix(table, features), table.column(target).to_numpy(), table.column("pos").to_numpy()
        size, k = int(table.column("train_size")[0].as_py()), int(table.column("_setting")[0].as_py())
        params = settings[k]
        log = bool(params.get("log", DEFAULTS["log"]))
        inner, train, test = pos <= size - horizon, pos <= size, pos > size
        if inner.sum() < 10 or not test.any():
            return pa.Table.from_batches([], schema=pa.schema([(f.name, table.schema.field(f.name).type if f.name in keys else t) for f, t in zip(
                out, [None] * len(keys) + [pa.string(), pa.date32(), pa.float64(), pa.float64(), pa.int32(), pa.int32()])]))
        t = _to(y, log)
        n = max(1, len(Boosted(params).fit(x[inner], t[inner], rounds, (x[train & ~inner], t[train & ~inner]), patience).trees))
        ahead = _back(Boosted(params).fit(x[train], t[train], n).predict(x[test]), log)
        rows_out = table.filter(pa.array(test))
        m = rows_out.num_rows
        return pa.table({**{c: rows_out.column(c) for c in keys}, "model": pa.array([model] * m, pa.string()), "date": rows_out.column("date"),
                         "actual": pa.array(y[test]), "forecast": pa.array(ahead), "setting": pa.array([k] * m, pa.int32()), "rounds": pa.array([n] * m, pa.int32())})

    return used.groupBy(*keys).applyInArrow(run, out)
