"""Ward linkage over clustering features.

A clustering feature is (n, sum, square sum) of some rows; features add up, so Spark
builds them with a grouped aggregate. Equal rows share one. Where more than
``max_features`` are left, rows share a cell of a grid whose side doubles until few enough
remain: each level is the sum of the finer one's features. Up to ``max_features`` distinct
rows the linkage is therefore exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.session import written

FINEST = 30  # halvings of each feature's range on the first grid


def merge(n: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Cluster number of each feature after merging down to ``k``; ties go to the features that come first.

    The increase in squared error of a merge is kept for all pairs and brought up to date
    by the Lance-Williams rule.
    """
    m = len(n)
    owner, size = np.arange(m), n.astype(float).copy()
    cost = ((centre[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2) * (size[:, None] * size[None, :] / (size[:, None] + size[None, :]))
    np.fill_diagonal(cost, np.inf)
    for _ in range(m - k):
        a, b = sorted(divmod(int(cost.argmin()), m))
        new = ((size[a] + size) * cost[a] + (size[b] + size) * cost[b] - size * cost[a, b]) / (size[a] + size[b] + size)
        size[a] += size[b]
        cost[a], cost[:, a] = new, new
        cost[b], cost[:, b], cost[a, a] = np.inf, np.inf, np.inf
        owner[owner == owner[b]] = owner[a]
    return np.unique(owner, return_inverse=True)[1]


def ward(df: DataFrame, key: str, feats: list[str], k: int = 2, max_features: int = 1000) -> DataFrame:
    """(key, cluster): ``k`` clusters by Ward linkage, numbered by their smallest key.

    Null features count as 0. Fewer distinct rows than ``k`` give as many clusters. No
    rows give no rows.
    """
    d = len(feats)
    rows = written(df.select(key, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feats]).alias("f")))
    sums = [F.sum(F.col("f")[j]).alias(f"s{j}") for j in range(d)] + [F.sum(F.col("f")[j] * F.col("f")[j]).alias(f"q{j}") for j in range(d)]
    added = [F.sum(f"{x}{j}").alias(f"{x}{j}") for x in "sq" for j in range(d)]
    rows = rows.withColumn("cell", F.col("f"))
    table = written(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), *sums))
    if table.limit(max_features + 1).count() > max_features:
        ends = rows.agg(*[x for j in range(d) for x in (F.min(F.col("f")[j]).alias(f"a{j}"), F.max(F.col("f")[j]).alias(f"b{j}"))]).first()
        low, side = [ends[f"a{j}"] for j in range(d)], [(ends[f"b{j}"] - ends[f"a{j}"]) / (1 << FINEST) or 1.0 for j in range(d)]

        def grid(level: int):
            return F.array(*[F.shiftright(F.least(F.floor((F.col("f")[j] - F.lit(low[j])) / F.lit(side[j])).cast("long"), F.lit((1 << FINEST) - 1)), level)
                             for j in range(d)])
        cells = written(rows.withColumn("cell", grid(0)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), *sums))
        level = 0
        while cells.count() > max_features:
            level += 1
            up = cells.withColumn("cell", F.transform("cell", lambda c: F.shiftright(c, 1)))
            cells = written(up.groupBy("cell").agg(F.sum("n").alias("n"), F.min("first").alias("first"), *added))
        rows, table = rows.withColumn("cell", grid(level)), cells
    some = table.orderBy("first").collect()  # max_features rows
    if not some:
        return df.select(key, F.lit(0).alias("cluster")).limit(0)
    n = np.array([r.n for r in some], float)
    centre = np.array([[r[f"s{j}"] for j in range(d)] for r in some], float) / n[:, None]
    label = merge(n, centre, min(k, len(some)))
    order = {c: i for i, c in enumerate(dict.fromkeys(label.tolist()))}  # rows are in order of their smallest key
    named = df.sparkSession.createDataFrame([(r.cell, order[c]) for r, c in zip(some, label.tolist())], table.select("cell").schema.add("cluster", "integer"))
    return rows.join(F.broadcast(named), "cell").select(key, "cluster")
