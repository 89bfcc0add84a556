"""op8 learns from every labelled row: the optimum, moments and cut of all pairs, none of a sample."""

import numpy as np
import pyarrow as pa
import pytest

from tillcast.llm import quality
from tillcast.llm.common import text_chunks


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").where("text is not null and quality is not null").select("doc_id", "text", "quality").limit(300).toPandas()


def test_model_is_the_optimum_of_all_pairs(spark, labelled):
    x = quality.features(list(text_chunks(pa.array(labelled.text.tolist()), 1 << 30))[0])
    y = labelled.quality.to_numpy()
    # a start from few rows must not show in the result
    m = quality.train(spark.createDataFrame(labelled).repartition(3), max_rows=40)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    assert np.allclose(m["mean"], mean, atol=1e-10)
    z, w = (x - mean) / spread, m["w"] * spread
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, x.shape[1])
    slope = -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + quality.RIDGE * w
    assert np.abs(slope).max() < 2e-8
    r = z @ w
    assert m["cut"] == pytest.approx(np.quantile(r, (y == 0).mean(), method="midpoint"), abs=1e-7)
    assert m["scale"] == pytest.approx(r.std() / 4, rel=1e-7)


def test_pull_of_all_texts_of_the_other_label():
    r = np.random.default_rng(4)
    own, other = r.normal(0, 4, 300), np.append(r.normal(1, 9, 200), [400.0, -400.0])
    bins, at = np.unique(np.floor(other / quality.BIN).astype(int), return_inverse=True)
    away = other - (bins[at] + 0.5) * quality.BIN
    sums = np.stack([np.bincount(at, away ** k) for k in range(quality.TERMS)], 1)
    mine, at = np.unique(np.floor(own / quality.BIN).astype(int), return_inverse=True)
    d = own - (mine[at] + 0.5) * quality.BIN
    for sign in (1, -1):
        got = (quality._pull(sign, mine, bins, sums)[at] * d[:, None] ** np.arange(quality.TERMS)).sum(axis=1)
        want = (1 / (1 + np.exp(-np.clip(sign * (own[:, None] - other), -700, 700)))).sum(axis=1)
        assert np.abs(got - want).max() < 1e-10
