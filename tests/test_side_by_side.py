"""Starts of k-means run side by side, with the models of one after the other."""

import threading
import time

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from tillcast.operators import segment as S


@pytest.fixture(scope="module")
def vec(spark):
    rows = spark.range(60).select("id", *[F.round(F.abs(F.sin(F.col("id") * (3 + i))) + F.col("id") % 3, 3).alias(f"x{i}") for i in range(3)])
    return S.assemble(rows.repartition(1), "id", ["x0", "x1", "x2"])


def test_starts_overlap_and_the_least_cost_is_kept(vec, monkeypatch):
    alone = {s: KMeans(k=4, seed=s, maxIter=S.MAX_ITER).fit(vec).summary.trainingCost for s in S.STARTS}
    lock, now, most, seen = threading.Lock(), 0, 0, []
    fit = KMeans.fit

    def watched(self, *args):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
            seen.append((self.getK(), self.getSeed()))
        time.sleep(0.2)
        try:
            return fit(self, *args)
        finally:
            with lock:
                now -= 1

    monkeypatch.setattr(KMeans, "fit", watched)
    best = S.best_kmeans(vec, 4)
    assert most > 1 and sorted(seen) == [(4, s) for s in S.STARTS]
    assert best.summary.trainingCost == min(alone.values())


def test_sweep_is_that_of_single_fits(vec):
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    want = []
    for k in (2, 3, 5):
        fits = [KMeans(k=k, seed=s, maxIter=S.MAX_ITER).fit(vec) for s in range(3)]
        want.append((k, ev.evaluate(min(fits, key=lambda m: m.summary.trainingCost).transform(vec))))
    assert [tuple(r) for r in S.silhouette_sweep(vec, (2, 3, 5), range(3)).orderBy("k").collect()] == want
