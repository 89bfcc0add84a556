"""Learned operators against plain Python over the same model, text by text."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tillcast.llm import langid, quality, toxicity, words
from tillcast.llm.common import text_chunks

SMALL = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def chunk(*texts):
    return list(text_chunks(pa.array(list(texts), pa.string()), 1 << 30))[0]


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()]


# --- language

def grams(text):
    sym = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text]
    for n in (1, 2, 3):
        for i in range(len(sym) - n + 1):
            if any(c.isalpha() for c in text[i:i + n]) and (n < 3 or text[i + 1].isalpha()):
                h = n * 0x85EBCA6B & 0xFFFFFFFF
                for s in sym[i:i + n]:
                    h = (h ^ s) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                yield h >> 16


def test_language_model_and_scores(spark, docs, edge):
    rows = [d for d in docs[:60] if d[1] is not None]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels, logp, prior = langid.train(frame)
    count = {k: Counter(g for _, t, lang in rows if lang == k for g in grams(t)) for k in {r[2] for r in rows} - {None}}
    assert labels == sorted(count)
    for j, k in enumerate(labels):
        total = sum(count[k].values()) + 0.5 * langid.FEATURES
        for g in list(count[k])[:300] + [12345]:
            assert logp[g, j] == pytest.approx(math.log((count[k][g] + 0.5) / total), abs=1e-12)
        assert prior[j] == pytest.approx(math.log(sum(r[2] == k for r in rows) / sum(r[2] is not None for r in rows)))
    more = spark.createDataFrame([(d[0], d[1]) for d in docs[60:110]] + [(r.doc_id, r.text) for r in edge.collect() if len(r.text or "") < 10_000],
                                 "doc_id long, text string")
    for r in langid.identify(spark, more, (labels, logp, prior)).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        at = np.array([prior[j] + sum(logp[g, j] for g in grams(r.text)) for j in range(len(labels))])
        p = 1 / np.exp(at - at.max()).sum()
        assert r.lang_pred == labels[int(at.argmax())] and r.score == pytest.approx(p, rel=1e-6, abs=1e-9)


def test_rare_languages_are_learned_whole(spark, monkeypatch):
    rows = [(k, f"the common tongue number {k} of many", "aa") for k in range(2000)] + [(5000 + k, f"szczęście źródło żółw {k}", "zz") for k in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels, logp, prior = langid.train(frame, max_rows=100)
    count = Counter(g for _, t, lang in rows if lang == "zz" for g in grams(t))
    total = sum(count.values()) + 0.5 * langid.FEATURES
    assert labels == ["aa", "zz"] and prior == pytest.approx([math.log(2000 / 2009), math.log(9 / 2009)])
    assert all(logp[g, 1] == pytest.approx(math.log((n + 0.5) / total)) for g, n in count.items())
    got = langid.identify(spark, spark.createDataFrame([(1, "źródło żółw"), (2, "common number")], "doc_id long, text string"), (labels, logp, prior))
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "zz", 2: "aa"}
    monkeypatch.setattr(langid, "MAX_LABELS", 1)
    with pytest.raises(ValueError):
        langid.train(frame)


# --- toxicity

def mix(h):
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & M64
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & M64
    return h ^ h >> 33


MUL = 0x9E3779B97F4A7C15


def fold(b):
    return re.sub(rb"\xc3[\x80-\x96\x98-\x9e]", lambda m: bytes([0xC3, m[0][1] + 32]), b.lower())


def word_hash(w):
    h, p = 0, 1
    for c in w:
        h = (h + mix(c + 1) * p) & M64
        p = p * MUL & M64
    return mix(h)


def plain_toxicity(text, w, b):
    """Noisy-or over sentences of the sum of the weights of words, pairs and parts of words."""
    low = fold((text or "").encode())
    clean = 1.0
    for sentence in re.split(rb"[.!?\n]", low):
        found = [(m.start(), m[0]) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", sentence)]
        if not found:
            continue
        h = [word_hash(x) for _, x in found]
        z = b + sum(w[x >> 46] for x in h) + sum(w[mix((x * 3 + y) & M64) >> 46] for x, y in zip(h, h[1:]))
        for _, x in found:
            sym = [0, *x, 0]
            for i in range(len(sym) - 4):
                g = 0
                for c in sym[i:i + 5]:
                    g = (g * MUL + c + 1) & M64
                z += w[(mix(g) >> 46) + toxicity.FEATURES]
        clean *= 1 - 1 / (1 + math.exp(-min(max(z, -30), 30)))
    return 1 - clean


def test_toxicity_scores_do_not_depend_on_the_batch(spark, docs, edge):
    r = np.random.default_rng(3)
    w = np.zeros(toxicity.SIZE)
    w[r.integers(0, toxicity.SIZE - 1, 200_000)] = r.normal(0, 0.4, 200_000)
    texts = [t for _, t, _ in docs[:40]] + [x.text for x in edge.collect() if len(x.text or "") < 5000] + ["word", "x", "ab cd", "end of it", "Ünder ÉCOLE", "longish"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 7):
        for x in toxicity.score_texts(spark, frame.repartition(parts), (w, -3.0)).collect():
            assert x.score == pytest.approx(plain_toxicity(x.text, w, -3.0), abs=1e-9), x.text


def test_toxicity_fit_is_where_the_gradient_vanishes():
    r = np.random.default_rng(5)
    plain, bad = ["".join(r.choice(list("aeioulnrst"), 6)) for _ in range(400)], ["grubly", "snarkel"]
    texts, label = [], []
    for k in range(300):
        lines = [" ".join(r.choice(plain, 6)) for _ in range(4)]
        if k % 3 == 0:
            lines[1] = " ".join([*r.choice(plain, 2), bad[k % 2], *r.choice(plain, 2)])
        texts.append(". ".join(lines) + f". n{k}")
        label.append(int(k % 3 == 0))
    w, b = toxicity._fit([chunk(*texts)], np.array(label))
    used = np.flatnonzero(w)
    assert len(used) and (np.abs(w) < 100).all()

    def loss(w, b):
        out = 0.0
        for t, y in zip(texts, label):
            p = min(max(plain_toxicity(t, w, b), 1e-15), 1 - 1e-15)
            out -= math.log(p if y else 1 - p)
        return out / len(texts) + toxicity.DECAY * (w ** 2).sum() / 2 / len(texts)
    now = loss(w, b)
    assert now < 0.1  # the labels are explained
    assert now <= loss(np.zeros_like(w), b) and now <= loss(w * 0.5, b) and now <= loss(w, b + 1) + 1e-9


def test_repeated_and_contradictory_labels(spark):
    from tillcast.llm.common import labelled_sample
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (1, 0), (2, 1), (2, 0), (9, 1), (3, None), (4, None), (4, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels.where("toxic is not null"), "doc_id", 100).collect()
    assert sorted((r.doc_id, r.toxic) for r in got) == [(0, 1), (1, 0), (4, 1)]


# --- quality

def plain_features(text):
    raw = (text or "").encode()
    kind = quality._KIND[np.frombuffer(raw, np.uint8)].tolist()
    shares = np.zeros(quality.KINDS ** 2)
    for (a, b), n in Counter(zip(kind, kind[1:])).items():
        shares[a * quality.KINDS + b] = math.sqrt(n / (len(raw) - 1))
    lines = [re.findall(rb"[0-9a-z\x80-\xff]+", x) for x in fold(raw).split(b"\n")]
    lines = [tuple(x) for x in lines if x]
    own = [x for line in lines for x in line]
    n, letters = max(len(own), 1), sum(map(len, own))
    return [*shares, math.log1p(len(raw)), math.log1p(len(own)), letters / n, math.log1p(letters / n), len(set(own)) / n,
            len(set(lines)) / max(len(lines), 1), math.log1p(len(own) / max(len(lines), 1))]


def test_quality_features_and_scores(spark, docs, edge):
    texts = [t for _, t, _ in docs[:60]] + [x.text for x in edge.collect() if len(x.text or "") < 20_000] + ["a\nb\na\n\nA", "É é\né"]
    assert np.allclose(quality.features(chunk(*texts)), [plain_features(t) for t in texts], atol=1e-9)
    r = np.random.default_rng(2)
    model = {"w": r.normal(0, 0.1, quality.FEATURES), "mean": r.random(quality.FEATURES), "cut": 0.2, "scale": 0.7}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality.score_texts(spark, frame.repartition(5), model).collect():
        at = (np.array(plain_features(x.text)) - model["mean"]) @ model["w"]
        want = 1 / (1 + math.exp(-((at - 0.2) / 0.7 + math.log(quality.CUT / (1 - quality.CUT)))))
        assert x.score == pytest.approx(want, abs=1e-9) and x.predicted == (want >= quality.CUT)


def test_quality_fit_is_the_optimum_of_the_pairs():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 6))
    y = (x[:, 0] - x[:, 1] + r.normal(size=400) > 0).astype(int)
    m = quality._fit(x, y)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, w = (x - mean) / spread, m["w"] * spread
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, quality.PAIRS)] - z[rng.choice(bad, quality.PAIRS)]
    slope = -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + quality.RIDGE * w
    assert np.abs(slope).max() < 1e-8
    found = np.zeros(6)
    for _ in range(3000):  # a plain optimiser reaches the same point
        found -= 0.5 * (-(d / (1 + np.exp(d @ found))[:, None]).mean(axis=0) + quality.RIDGE * found)
    assert np.allclose(found, w, atol=1e-5)
    assert m["cut"] == pytest.approx(np.quantile(z @ w, len(bad) / len(y), method="midpoint"))
    assert words.mix(np.array([5], np.uint64))[0] == mix(5)
