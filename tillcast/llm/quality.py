"""Text quality by Bradley-Terry ranking: scores learned from pairs, better against worse.

P(a beats b) = sigmoid(r(a) - r(b)) with r linear in features of the text's shape:
shares of pairs of neighbouring byte kinds, lengths, repetition of words and lines.
The model is the optimum over all pairs of a good and a bad labelled text. The pairs are
not formed: r is one number a text, so what a text is pulled by all texts of the other
label is a smooth function of r, a polynomial in each of a row of bins, which power sums
of the other label's r give to 14 digits. A step costs two passes over the labelled rows.
The cut between good and bad is the quantile of r that leaves the labelled share of
bad texts below it; the score is 0.7 there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillcast.functions.quantiles import exact_quantiles

from . import words
from .common import Chunk, Scratch, agreed_labels, col, crc_mod, read, small_batches, text_chunks, with_text_columns

MAX_ROWS = 8_000  # rows from which the first weights come; the steps over all rows go on from there
PAIRS = 20_000
BIN, TERMS = 0.5, 17  # width of a bin of r, and power sums kept in it
TOLERANCE, MOST_STEPS = 1e-8, 60
RIDGE, STEPS = 1e-2, 12
CUT = 0.7

KINDS = 16
_KIND = np.full(256, 15, np.uint8)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".",
                             ",;:", "!?", "'\"`", "-_", "()[]{}", "<>|\\/", "#$%&*@^~+="]):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:192] = 13
_KIND[192:] = 14
FEATURES = KINDS * KINDS + 7


def features(chunk: Chunk) -> np.ndarray:
    """One row of FEATURES numbers a text."""
    n = len(chunk)
    size = np.diff(chunk.offsets)
    kind = _KIND[chunk.data].astype(np.int64)
    text = np.repeat(np.arange(n), size)
    pair = kind[:-1] * KINDS + kind[1:]
    same = text[:-1] == text[1:]
    shares = np.bincount((text[:-1] * KINDS * KINDS + pair)[same], minlength=n * KINDS * KINDS).reshape(n, -1)
    shares = np.sqrt(shares / np.maximum(size - 1, 1)[:, None])
    w = words.Words(chunk.data, chunk.offsets)
    count = np.diff(w.first)
    of = np.repeat(np.arange(n), count)
    letters = words.sums_by((w.end - w.start).astype(np.float64), w.first)

    def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n)

    kinds_of_words = distinct(w.hash, of)
    line = np.cumsum(chunk.data == 10)[w.start] if len(of) else of
    head = np.ones(len(of), bool)
    head[1:] = (of[1:] != of[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(head)
    place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    pw = words.powers(int(place.max()) + 1 if len(of) else 1)
    hashes = np.add.reduceat(w.hash * pw[place], first) if len(first) else np.zeros(0, np.uint64)
    lines = np.bincount(of[first], minlength=n)
    kinds_of_lines = distinct(hashes, of[first])
    some = np.maximum(count, 1)
    return np.hstack([shares, np.column_stack([
        np.log1p(size), np.log1p(count), letters / some, np.log1p(letters / some), kinds_of_words / some,
        kinds_of_lines / np.maximum(lines, 1), np.log1p(count / np.maximum(lines, 1))])])


def _fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights of standardised features from random pairs of a good and a bad text, and the cut."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / spread
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):  # Newton steps on the logistic loss of differences
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (p - 1) / PAIRS + RIDGE * w
        h = (d * (p * (1 - p))[:, None]).T @ d / PAIRS + RIDGE * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    r = z @ w
    cut = float(np.quantile(r, len(bad) / len(y), method="midpoint"))
    return {"w": w / spread, "mean": mean, "cut": cut, "scale": float(r.std() / 4 + 1e-9)}


def _sigmoid_terms(d: np.ndarray) -> np.ndarray:
    """The first TERMS Taylor coefficients of the sigmoid at each d."""
    t = np.empty((TERMS, *d.shape))
    t[0] = 1 / (1 + np.exp(-np.clip(d, -700, 700)))
    for k in range(TERMS - 1):  # s' = s - s * s, as power series
        t[k + 1] = (t[k] - sum(t[i] * t[k - i] for i in range(k + 1))) / (k + 1)
    return t


def _pull(sign: int, own: np.ndarray, other: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Sum of sigmoid(sign * (r - s)) over all s of the other label, as a polynomial for each bin of ``own``.

    ``sums`` holds, for each bin of ``other``, the sums of powers of s less the bin's
    middle; the polynomial is in r less the bin's middle.
    """
    out = np.zeros((len(own), TERMS))
    for lo in range(0, len(own), 64):
        t = _sigmoid_terms(sign * BIN * (own[lo:lo + 64, None] - other).astype(float))
        for q in range(TERMS):
            for k in range(q, TERMS):
                out[lo:lo + 64, q] += math.comb(k, q) * sign ** k * (-1) ** (k - q) * (t[k] @ sums[:, k - q])
    return out


def _arrays(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, FEATURES)


def _total(rows: DataFrame, part) -> np.ndarray | None:
    """Sum of ``part(y, x)``, a vector, over all rows (y, x); None without rows.

    Tasks add up their rows, a few tasks the sums of those, one the rest.
    """
    def added(vectors):
        out = None
        for v in vectors:
            out = v if out is None else out + v
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["v"])

    def first(batches):
        return added(part(y, x) for y, x in _arrays(batches))

    def again(batches):
        return added(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).sum(axis=0) for b in batches if b.num_rows)

    got = (rows.select("y", "x").mapInArrow(first, "v array<double>").repartition(32).mapInArrow(again, "v array<double>")
           .repartition(1).mapInArrow(again, "v array<double>").collect())
    return np.array(got[0].v) if got else None


def _bins(rows: DataFrame, rank) -> list[tuple[np.ndarray, np.ndarray]]:
    """For label 0 and 1: the bins that hold an r, and the power sums in each."""
    def tally(batches):
        for y, x in _arrays(batches):
            r = rank(x)
            b = np.floor(r / BIN).astype(np.int64)
            d = r - (b + 0.5) * BIN
            key, at = np.unique(2 * b + y, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), *[pa.array(np.bincount(at, d ** k, len(key))) for k in range(TERMS)]],
                names=["key", *[f"m{k}" for k in range(TERMS)]])

    names = [f"m{k}" for k in range(TERMS)]
    sums = rows.select("y", "x").mapInArrow(tally, ", ".join(["key long", *[f"{m} double" for m in names]]))
    sums = sums.groupBy("key").agg(F.array(*[F.sum(m) for m in names]).alias("m"))
    got = sums.agg(F.sort_array(F.collect_list(F.struct("key", "m"))).alias("all")).collect()[0]["all"]
    key, m = np.array([g.key for g in got]), np.array([g.m for g in got])
    return [(key[key & 1 == y] >> 1, m[key & 1 == y]) for y in (0, 1)]


def _step(rows: DataFrame, w: np.ndarray, mean: np.ndarray, spread: np.ndarray):
    """Gradient and curvature of the mean loss of all pairs, mean and variance of r.

    The gradient is exact to rounding; the curvature takes r at the middle of its bin.
    """
    def rank(x):
        return ((x - mean) / spread) @ w

    bins = _bins(rows, rank)
    (bad, bad_sums), (good, good_sums) = bins
    pull = [_pull(1, bad, good, good_sums), _pull(-1, good, bad, bad_sums)]
    bend = _sigmoid_terms(BIN * (good[:, None] - bad).astype(float))[1]
    heavy = [bend.T @ good_sums[:, 0], bend @ bad_sums[:, 0]]
    middle = [(b + 0.5) * BIN for b, _ in bins]
    p = len(w)

    def part(y, x):
        z = (x - mean) / spread
        r = rank(x)
        slope, curve, sides = np.zeros(p), np.zeros((p, p)), []
        for label in (0, 1):
            mine = np.flatnonzero(y == label)
            zs, at = z[mine], np.searchsorted((middle[label][1:] + middle[label][:-1]) / 2, r[mine])
            d = r[mine] - middle[label][at]
            a = np.zeros(len(mine))
            for q in range(TERMS - 1, -1, -1):
                a = a * d + pull[label][at, q]
            slope += (1 - 2 * label) * (a @ zs)
            curve += (zs * heavy[label][at][:, None]).T @ zs
            side = np.zeros((len(middle[label]), p))
            np.add.at(side, at, zs)
            sides.append(side.ravel())
        return np.concatenate([slope, curve[np.triu_indices(p)], *sides])

    v = _total(rows, part)
    pairs = bad_sums[:, 0].sum() * good_sums[:, 0].sum()
    curve = np.zeros((p, p))
    tri = p * (p + 1) // 2
    curve[np.triu_indices(p)] = v[p:p + tri]
    curve = curve + np.triu(curve, 1).T
    side_bad, side_good = np.split(v[p + tri:].reshape(-1, p), [len(bad)])
    cross = side_good.T @ bend @ side_bad
    n = sum(m[:, 0].sum() for _, m in bins)
    mid = sum(c @ m[:, 0] + m[:, 1].sum() for c, (_, m) in zip(middle, bins)) / n
    var = sum((c - mid) ** 2 @ m[:, 0] + 2 * (c - mid) @ m[:, 1] + m[:, 2].sum() for c, (_, m) in zip(middle, bins)) / n
    return v[:p] / pairs + RIDGE * w, (curve - cross - cross.T) / pairs + RIDGE * np.eye(p), max(var, 0.0)


def _start(rows: DataFrame, n: float, max_rows: int) -> np.ndarray:
    """First weights (of features as they are), from at most about ``max_rows`` rows; zeros if they lack a label."""
    few = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "k"), F.lit(1 << 40)) < math.floor(min(1.0, max_rows / n) * (1 << 40)))

    def fit(batches):
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        y = got.column(0).to_numpy() if got is not None else np.zeros(0)
        w = np.zeros(FEATURES)
        if len(set(y.tolist())) == 2:
            x = got.column(1).combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
            order = np.lexsort((x[:, 0], got.column(2).to_numpy()))
            w = _fit(x[order], y[order])["w"]
        yield pa.RecordBatch.from_arrays([pa.array([w], pa.list_(pa.float64()))], names=["w"])

    got = few.select("y", "x", "k").repartition(1).mapInArrow(fit, "w array<double>").collect()
    return np.array(got[0].w) if got else np.zeros(FEATURES)


def train(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_rows: int = MAX_ROWS) -> dict:
    """Model of all labelled rows. Rows with a null text or a label other than 0 and 1 teach nothing.

    Newton steps go on until the gradient over all pairs vanishes, so the result does not
    depend on the first weights. Without rows of both labels there are no pairs: every
    text then scores the share of label 1 (0.5 if there are no labels).
    """
    spark = labelled.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "quality")

    def extract(batches):
        for batch in batches:
            for c in text_chunks(batch.column(0)):
                y, k = (batch.column(i).slice(c.start, len(c)) for i in (1, 2))
                flat = pa.array(features(c).ravel())
                at = pa.array(np.arange(len(c) + 1) * FEATURES, pa.int32())
                yield pa.RecordBatch.from_arrays([y, k, pa.ListArray.from_arrays(at, flat)], names=["y", "k", "x"])

    rows = labelled.where(col(label).isin(0, 1) & col(text).isNotNull())
    rows = scratch.keep(rows.select(col(text), col(label).cast("int"), F.xxhash64(col(key)))
                        .mapInArrow(extract, "y int, k long, x array<double>"))
    got = _total(rows, lambda y, x: np.concatenate([[len(y) - y.sum(), y.sum()], x.sum(axis=0)]))
    n_bad, n_good = got[:2] if got is not None else (0, 0)
    n = n_bad + n_good
    if not n_bad or not n_good:
        scratch.drop(rows)
        return {"share": float(n_good / n) if n else 0.5}
    mean = got[2:] / n
    spread = np.sqrt(_total(rows, lambda y, x: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-6
    w = _start(rows, n, max_rows) * spread
    best, least = w, math.inf
    for _ in range(MOST_STEPS):
        slope, curve, var = _step(rows, w, mean, spread)
        size = np.abs(slope).max()
        if size < TOLERANCE:
            break
        if size >= least:  # too far: half the way
            w = (w + best) / 2
        else:
            best, least = w, size
            w = w - np.linalg.solve(curve, slope)
    else:
        raise RuntimeError(f"no optimum after {MOST_STEPS} steps, gradient {least}")

    def ranks(batches):
        for _, x in _arrays(batches):
            yield pa.RecordBatch.from_arrays([pa.array(((x - mean) / spread) @ w)], names=["r"])

    # halfway between the ranks on either side of the share of label 0
    cut = exact_quantiles(rows.select("y", "x").mapInArrow(ranks, "r double"), ["r"], [(n_bad - 0.5) / (n - 1)])["r"][0]
    scratch.drop(rows)
    return {"w": w / spread, "mean": mean, "cut": cut, "scale": math.sqrt(var) / 4 + 1e-9}


def score_texts(spark: SparkSession, docs: DataFrame, model: dict, text: str = "text", threshold: float = CUT) -> DataFrame:
    """docs with ``score`` (0 to 1, CUT at the quantile) and ``predicted`` (score at least threshold).

    Null counts as empty; an empty text is scored like any other, by its features, all
    of them zero. Columns of those names are replaced; every row is kept.
    """
    shared = spark.sparkContext.broadcast(model)

    def maker():
        m = shared.value

        def run(chunk: Chunk):
            if "share" in m:
                score = np.full(len(chunk), m["share"])
            else:
                r = (features(chunk) - m["mean"]) @ m["w"]
                score = 1 / (1 + np.exp(-np.clip((r - m["cut"]) / m["scale"] + np.log(CUT / (1 - CUT)), -36, 36)))
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
        return run

    return with_text_columns(docs, text, "score double, predicted int", maker)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 4) == 2
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", "quality").where("quality is not null")
    # labels grow with the documents: neither broadcast nor sorted, hashed a partition at a time
    model = train(docs.where(~held_out & F.col("text").isNotNull()).join(agreed_labels(labels, "doc_id").hint("shuffle_hash"), "doc_id"))
    return score_texts(spark, docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
