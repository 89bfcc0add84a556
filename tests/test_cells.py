"""DBSCAN on cells against brute force, and a crowded spot that forms no square of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.operators import dbscan


def brute(x, eps, min_samples):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    near = d <= eps
    n = near.sum(axis=1)
    core = n >= min_samples
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack = [i]
            label[i] = i
            while stack:
                k = stack.pop()
                for j in np.flatnonzero(near[k] & core & (label < 0)):
                    label[j] = i
                    stack.append(j)
    for i in np.flatnonzero(~core):
        some = label[near[i] & core]
        label[i] = some.min() if len(some) else -1
    ids = {v: k for k, v in enumerate(sorted(set(label) - {-1}))}
    return n.tolist(), [ids.get(v, -1) for v in label]


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))


def cloud(seed, d):
    g = np.random.default_rng(seed)
    return np.concatenate([g.normal(0, 0.3, (120, d)), g.normal(2.2, 0.02, (60, d)), g.uniform(-4, 4, (60, d)), np.full((15, d), -3.0),
                           np.round(g.normal(0, 1, (40, d)))])


@pytest.mark.parametrize("d, eps, least", [(2, 0.3, 5), (3, 0.5, 6)])
def test_labels_and_counts_equal_brute_force(spark, d, eps, least):
    x = cloud(d, d)
    cols = [f"x{j}" for j in range(d)]
    n, label = brute(x, eps, least)
    df = frame(spark, x)
    assert [r.n_neighbours for r in dbscan.core_points(df, "id", cols, eps, least).orderBy("id").collect()] == n
    assert [r.cluster for r in dbscan.dbscan(df, "id", cols, eps, least).orderBy("id").collect()] == label


@pytest.mark.parametrize("gap, joined", [(0.999, True), (1.001, False)])
def test_crowded_cells_side_by_side(spark, gap, joined):
    g = np.random.default_rng(4)
    a = np.column_stack([g.uniform(-0.3, 0, 400), g.uniform(0, 0.3, 400)])
    b = np.column_stack([g.uniform(0, 0.3, 400) + gap, g.uniform(0, 0.3, 400)])
    a[0], b[0] = (0, 0.1), (gap, 0.1)
    x = np.concatenate([a, b])
    got = [r.cluster for r in dbscan.dbscan(frame(spark, x), "id", ["x0", "x1"], 1.0, 5).orderBy("id").collect()]
    assert got == brute(x, 1.0, 5)[1] and (len(set(got)) == 1) == joined


def test_a_crowded_spot_forms_no_square_of_pairs(spark, monkeypatch):
    n = 100_000
    df = spark.range(n).select("id", (F.rand(1) * 0.5).alias("x0"), (F.rand(2) * 0.5).alias("x1"))
    far = spark.createDataFrame([(n + k, float(0.25 + 0.99 * np.cos(k)), float(0.25 + 0.99 * np.sin(k))) for k in range(3)], "id long, x0 double, x1 double")
    rows = []
    keep = dbscan.written

    def counted(t):
        out = keep(t)
        rows.append(out.count())
        return out
    monkeypatch.setattr(dbscan, "written", counted)
    got = dbscan.dbscan(df.unionByName(far), "id", ["x0", "x1"], 1.0, 50).groupBy("cluster").count().collect()
    assert [(r.cluster, r["count"]) for r in got] == [(0, n + 3)]
    assert max(rows) <= 2 * n


def test_no_points(spark):
    assert dbscan.dbscan(frame(spark, np.zeros((1, 2))).where("false"), "id", ["x0", "x1"], 1.0, 3).count() == 0
    assert [r.cluster for r in dbscan.dbscan(frame(spark, np.zeros((1, 2))), "id", ["x0", "x1"], 1.0, 3).collect()] == [-1]
