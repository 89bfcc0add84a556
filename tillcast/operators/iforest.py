"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

1. Sampling: each row joins tree t when xxhash64(row key, t) falls under a rate
   that yields about 1.5 x psi rows per tree; the candidate tree ids are computed
   per row with an array filter, so rows are not multiplied by the tree count.
2. Build: groupBy(tree).applyInPandas grows one tree from psi rows (the published
   algorithm's subsample, a parameter of the forest; every row is scored).
3. Trees (at most T x (2 psi - 1) nodes) come back to the driver once and are
   broadcast to an Arrow pandas UDF that scores every row: 2^(-E[h(x)] / c(psi)).
4. The flag threshold is the (1 - contamination) quantile of the scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import written

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size int, depth int")


def c_factor(n):
    """Average unsuccessful-search path length in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649015329) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    nodes = []  # (feature, threshold, left, right, size, depth)

    def build(idx, depth):
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx), depth])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return me
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[me][0], nodes[me][1], nodes[me][2], nodes[me][3] = f, thr, left, right
        return me

    build(np.arange(len(x)), 0)
    return nodes


def build_trees(sample: DataFrame, features: list[str], psi: int, seed: int) -> DataFrame:
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_h").head(psi)
        x = pdf[features].to_numpy(dtype=float)
        x = np.nan_to_num(x, nan=0.0)
        nodes = _grow(x, np.random.default_rng(seed * 100003 + t), max_depth)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "node", np.arange(len(out), dtype=np.int32))
        out.insert(0, "tree", np.int32(t))
        return out.astype({"feature": "int32", "left": "int32", "right": "int32", "size": "int32",
                           "depth": "int32"})

    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def _pack(nodes: pd.DataFrame):
    trees = []
    for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
        trees.append((g.feature.to_numpy(), g.threshold.to_numpy(), g.left.to_numpy(), g.right.to_numpy(),
                      g["size"].to_numpy(), g.depth.to_numpy()))
    return trees


def isolation_forest(df: DataFrame, key_cols: list[str], features: list[str], n_trees: int = 100,
                     psi: int = 256, contamination: float = 0.002, seed: int = 42) -> DataFrame:
    """Adds ``if_score`` and ``if_anomaly`` (1 = outlier) to every row of ``df``."""
    spark = df.sparkSession
    n = df.count()
    psi = min(psi, n)
    rate = min(1.0, 1.5 * psi / max(n, 1))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols])
    m = 1 << 62
    thr = int(rate * m)  # 62 bits: a rate of 1e-12 still selects rows
    trees_for_row = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                             lambda t: F.pmod(F.xxhash64(key, t, F.lit(seed)), F.lit(m)) < F.lit(thr))
    sample = (df.select(*features, key.alias("_k"), F.explode(trees_for_row).alias("tree"))
                .withColumn("_h", F.xxhash64("_k", "tree")))
    nodes = build_trees(sample, features, psi, seed).toPandas()
    packed = spark.sparkContext.broadcast(_pack(nodes))
    cpsi = float(c_factor([psi])[0])

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(dtype=float) for c in cols]), nan=0.0)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feat, th, left, right, size, depth in packed.value:
            cur = np.zeros(len(x), dtype=int)
            while True:
                f = feat[cur]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.where(inner, f, 0)] < th[cur]
                nxt = np.where(go_left, left[cur], right[cur])
                cur = np.where(inner, nxt, cur)
            total += depth[cur] + c_factor(size[cur])
        return pd.Series(np.power(2.0, -(total / len(packed.value)) / cpsi))

    scored = df.withColumn("if_score", score(*[F.col(c).cast("double") for c in features]))
    from tillcast.functions.quantiles import exact_quantiles
    scored = written(scored)
    cut = exact_quantiles(scored, ["if_score"], [1.0 - contamination])["if_score"][0]
    return scored.withColumn("if_anomaly", (F.col("if_score") > F.lit(cut)).cast("int"))
