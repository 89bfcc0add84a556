"""Euclidean silhouette, exact or estimated from scored rows of every cluster.

A scored row is compared with all rows: its mean distance to each cluster needs only sums,
which tasks add up beside the broadcast scored rows. Up to ``max_scored`` rows all are
scored. Beyond it each cluster gives an equal number, chosen by a hash of the key; their
mean, weighted by cluster size, has a standard error that is returned with it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillcast.session import written


def silhouette(labels: DataFrame, points: DataFrame, key: str, feats: list[str], cluster: str = "cluster", max_scored: int = 2000) -> DataFrame:
    """One row (silhouette, standard_error, n_scored, n_rows, n_clusters).

    A row alone in its cluster scores 0. Fewer than two clusters, or no rows, give -1.
    Clusters may number ``max_scored`` / 2 at most, so that each has two scored rows.
    """
    d = len(feats)
    rows = written(labels.select(key, F.col(cluster).alias("c")).join(points.select(key, *feats), key).select(
        F.col(key).alias("id"), F.col("c").cast("string").alias("c"), F.array(*[F.col(f).cast("double") for f in feats]).alias("f")))
    spark = rows.sparkSession
    out = "silhouette double, standard_error double, n_scored long, n_rows long, n_clusters int"
    size = {r.c: r.n for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy("c").limit(max_scored // 2 + 1).collect()}
    n = sum(size.values())
    if len(size) > max_scored // 2:
        raise ValueError(f"more than {max_scored // 2} clusters")
    if len(size) < 2:
        return spark.createDataFrame([(-1.0, 0.0, 0, n, len(size))], out)
    each = max_scored if n <= max_scored else max_scored // len(size)
    near = Window.partitionBy("c").orderBy(F.xxhash64("id"), "id")
    wide = 1 << 40
    # of a large cluster only rows of small hashes are ranked, four times as many as are taken
    hashed = F.pmod(F.xxhash64("id"), F.lit(wide))
    limits = F.create_map(*[x for c, m in size.items() for x in (F.lit(c), F.lit(wide if m <= 4 * each + 100 else math.ceil(wide * (4 * each + 100) / m)))])
    picked = rows.where(hashed < limits[F.col("c")]).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= each).select("id", "c", "f").collect()
    names = list(size)
    number = {c: i for i, c in enumerate(names)}
    x = np.array([r.f for r in picked], float).reshape(-1, d)
    shared = spark.sparkContext.broadcast(x)

    def add(batches):
        centre, total = shared.value, np.zeros((len(names), len(shared.value)))
        for batch in batches:
            own = np.array([number[c] for c in batch.column("c").to_pylist()], np.int64)
            f = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for lo in range(0, len(f), 512):
                gap = np.zeros((len(f[lo:lo + 512]), len(centre)))
                for j in range(d):
                    gap += (f[lo:lo + 512, j][:, None] - centre[:, j]) ** 2
                np.add.at(total, own[lo:lo + 512], np.sqrt(gap))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(names)), len(centre)), pa.int32()), pa.array(np.tile(np.arange(len(centre)), len(names)), pa.int32()),
                                          pa.array(total.ravel())], names=["cluster", "row", "total"])

    sums = rows.select("c", "f").mapInArrow(add, "cluster int, row int, total double").groupBy("cluster", "row").agg(F.sum("total").alias("total"))
    total = np.zeros((len(names), len(picked)))
    for r in sums.collect():  # clusters x scored rows
        total[r.cluster, r.row] = r.total
    counts, own = np.array([size[c] for c in names], float), np.array([number[r.c] for r in picked])
    at = np.arange(len(picked))
    inside = total[own, at] / np.maximum(counts[own] - 1, 1)
    mean = total / counts[:, None]
    mean[own, at] = np.inf
    other = mean.min(axis=0)
    most = np.maximum(inside, other)
    score = np.where((counts[own] > 1) & (most > 0), (other - inside) / np.where(most > 0, most, 1), 0.0)
    value = error = 0.0
    for c in range(len(names)):
        s = score[own == c]
        value += counts[c] / n * s.mean()
        if len(s) < counts[c]:
            error += (counts[c] / n) ** 2 * s.var(ddof=1) / len(s) * (1 - len(s) / counts[c])
    return spark.createDataFrame([(float(value), math.sqrt(error), len(picked), n, len(names))], out)
