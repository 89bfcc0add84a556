"""Neighbours over all rows, linkage and silhouettes against brute force."""

import itertools

import duckdb
import numpy as np
import pytest

from tillcast.operators import neighbours, silhouette, ward

SMALL = "/root/testdata/sf0.001"


def points(n, d, seed, grid=None):
    g = np.random.default_rng(seed)
    x = np.concatenate([g.normal(c, s, (n // 4, d)) for c, s in ((0, 1), (5, 0.1), (-4, 3), (0, 0.01))])
    return np.round(x * grid) / grid if grid else x


def frame(spark, x):
    return spark.createDataFrame([(f"r{i:05d}", *map(float, v)) for i, v in enumerate(x)], "row string, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))


def brute(x, k):
    d = neighbours.distances(x, x)
    np.fill_diagonal(d, np.inf)
    return {(f"r{i:05d}", f"r{j:05d}"): d[i, j] for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k] if np.isfinite(d[i, j])}


@pytest.mark.parametrize("x, k, cell", [
    (points(600, 2, 1), 7, 40), (points(400, 3, 2, grid=2), 10, 25), (np.zeros((300, 2)), 5, 20), (points(8, 2, 3), 10, 3),
    (np.vstack([np.zeros((200, 2)), points(200, 2, 4)]), 6, 15)])
def test_neighbours_equal_brute_force(spark, x, k, cell):
    got = neighbours.nearest_all(frame(spark, x), "row", [f"x{j}" for j in range(x.shape[1])], k, cell, chunk_rows=50).collect()
    want = brute(x, k)
    assert len(got) == len(want) and {(r.row, r._o): r._d for r in got} == want
    last = {}
    for (a, _), v in want.items():
        last[a] = max(v, last.get(a, 0))
    assert all(r._kdist == last[r.row] for r in got)


def test_cells_are_left_out(spark, monkeypatch):
    seen = []
    low = neighbours.bounds
    x = points(800, 2, 5)
    cells = {"pivot": np.array([0]), "hi": np.array([2.0]), "lo": np.array([1.0]), "min": np.array([[0.0, 0.0]]), "max": np.array([[1.0, 1.0]])}
    g = np.random.default_rng(0)
    inside = g.random((300, 2))
    pivot = np.array([[-0.5, -0.5]])
    far = neighbours.distances(inside, pivot)[:, 0]
    inside = inside[(far >= 1) & (far <= 2)]
    a, b = low(x, neighbours.distances(x, pivot), cells)
    d = neighbours.distances(x, inside)
    assert (a[:, 0] <= d.min(axis=1) + 1e-12).all() and (b[:, 0] >= d.max(axis=1) - 1e-12).all()
    assert not seen


def test_no_and_one_row(spark):
    df = frame(spark, np.ones((1, 2)))
    assert neighbours.nearest_all(df, "row", ["x0", "x1"], 3).count() == 0
    assert neighbours.nearest_all(df.where("false"), "row", ["x0", "x1"], 3).count() == 0


def test_factor_of_all_rows_equals_sql(spark):
    from tillcast.operators.lof import lof_all
    from tillcast.plans.q_anomaly import LOF_FEATURES, detector_features
    from tillcast.plans.registry import Views
    from pyspark.sql import functions as F
    g, _ = detector_features(Views(spark, SMALL))
    g = g.withColumn("row", F.concat_ws("|", "store", "dept", "date"))
    pdf = g.select("row", *LOF_FEATURES).toPandas()
    got = lof_all(spark.createDataFrame(pdf), "row", LOF_FEATURES, 40, cell_rows=200).toPandas().set_index("row")
    con = duckdb.connect()
    con.register("pts", pdf)
    dist = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in LOF_FEATURES)
    want = con.execute(f"""
        with d as (select a."row" as p, b."row" as o, sqrt({dist}) as d from pts a join pts b on a."row" <> b."row"),
        knn as (select * from (select *, row_number() over (partition by p order by d, o) as r from d) where r <= 40),
        kd as (select p, max(d) as k from knn group by p),
        lrd as (select n.p, 1 / (avg(greatest(kd.k, n.d)) + 1e-10) as l from knn n join kd on kd.p = n.o group by n.p)
        select n.p, avg(o.l) / max(p.l) as lof from knn n join lrd o on o.p = n.o join lrd p on p.p = n.p group by n.p""").df().set_index("p")
    assert len(want) == len(got) == len(pdf)
    assert np.allclose(got.lof.sort_index(), want.lof.sort_index(), rtol=1e-6, atol=1e-6)
    cut = np.quantile(got.lof, 0.995)
    assert (got.lof_anomaly == (got.lof > cut)).all() and 0 < got.lof_anomaly.sum() < len(got) / 100


# --- linkage

def exact_ward(x, k):
    groups = [[i] for i in range(len(x))]
    error = lambda g: ((x[g] - x[g].mean(axis=0)) ** 2).sum()
    while len(groups) > k:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: error(groups[p[0]] + groups[p[1]]) - error(groups[p[0]]) - error(groups[p[1]]))
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [sorted(groups[a] + groups[b])]
    return sorted(tuple(sorted(g)) for g in groups)


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, []).append(int(r[0][1:]))
    assert [min(out[c]) for c in sorted(out)] == sorted(min(g) for g in out.values())
    return sorted(tuple(sorted(g)) for g in out.values())


@pytest.mark.parametrize("k", [1, 2, 5])
def test_linkage_is_exact_for_few_rows(spark, k):
    x = points(40, 3, 8)
    assert clusters(ward.ward(frame(spark, x), "row", ["x0", "x1", "x2"], k)) == exact_ward(x, k)


def test_equal_rows_and_few_of_them(spark):
    x = np.array([[0.0, 0], [0, 0], [9, 9], [0, 0]])
    assert clusters(ward.ward(frame(spark, x), "row", ["x0", "x1"], 2)) == [(0, 1, 3), (2,)]
    assert clusters(ward.ward(frame(spark, x), "row", ["x0", "x1"], 7)) == [(0, 1, 3), (2,)]
    assert ward.ward(frame(spark, x).where("false"), "row", ["x0", "x1"], 2).count() == 0


def test_many_rows_are_summed_up_first(spark):
    g = np.random.default_rng(6)
    x = np.concatenate([g.normal(c, 0.3, (700, 2)) for c in (0, 6, 20)])
    got = clusters(ward.ward(frame(spark, x), "row", ["x0", "x1"], 3, max_features=60))
    assert got == [tuple(range(700 * i, 700 * i + 700)) for i in range(3)]


def test_linkage_of_the_stores(spark):
    import __spark_entry__ as E
    from tillcast.plans.q_segment import _scaled_store_features
    pts, cols = _scaled_store_features(spark, SMALL)
    rows = sorted(pts.collect(), key=lambda r: r.store)
    want = exact_ward(np.array([[r[c] for c in cols] for r in rows], float), 2)
    got = {r.store: r.cluster for r in E.queries()["hierarchical"](spark, SMALL).collect()}
    label = {i: n for n, g in enumerate(sorted(want, key=min)) for i in g}
    assert [got[r.store] for r in rows] == [label[i] for i in range(len(rows))]


# --- silhouettes

def brute_silhouette(x, c):
    d = neighbours.distances(x, x)
    s = []
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][c == o].mean() for o in set(c) - {c[i]})
        s.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(s))


def test_silhouette_exact_and_estimated(spark):
    x = points(2000, 2, 11)
    c = np.where(x[:, 0] > 2, 0, np.where(x[:, 1] > 0, 1, 2))
    c[5] = 3
    pts = frame(spark, x)
    lab = spark.createDataFrame([(f"r{i:05d}", int(v)) for i, v in enumerate(c)], "row string, cluster int")
    want = brute_silhouette(x, c)
    exact = silhouette.silhouette(lab, pts, "row", ["x0", "x1"]).first()
    assert exact.silhouette == pytest.approx(want, abs=1e-9) and exact.standard_error == 0 and exact.n_scored == 2000
    some = silhouette.silhouette(lab, pts, "row", ["x0", "x1"], max_scored=400).first()
    assert some.n_scored == 301 and 0 < some.standard_error < 0.05
    assert abs(some.silhouette - want) < 3 * some.standard_error


def test_silhouette_of_one_cluster(spark):
    pts = frame(spark, np.ones((3, 1)))
    lab = spark.createDataFrame([(f"r{i:05d}", 0) for i in range(3)], "row string, cluster int")
    assert silhouette.silhouette(lab, pts, "row", ["x0"]).first().silhouette == -1
    assert silhouette.silhouette(lab.where("false"), pts, "row", ["x0"]).first().n_rows == 0
