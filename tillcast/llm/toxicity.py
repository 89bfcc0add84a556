"""Toxicity by multiple-instance learning: a text is toxic if any sentence is.

A sentence's probability is a logistic model over hashed words, word pairs and parts
of words. A text's is their noisy-or, 1 - prod(1 - p). Only texts have labels; the gradient of
the text's likelihood is shared out among its sentences, so the model learns which
of them are to blame and can name them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words
from .common import Chunk, bounded_sample, col, crc_mod, labelled_sample, read, text_chunks, with_text_columns

FEATURES = 1 << 18  # hashed places for words and pairs, and as many again for parts of words
GRAM = 5  # bytes of a part of a word; its first or last may be the gap beside the word
SIZE = 2 * FEATURES + 1  # the last place is "no feature"
MAX_ROWS, MAX_BYTES = 6_000, 9 << 20  # the training sample: at most about this many rows and bytes
MIN_CASES = 5  # a feature counts if it stands in so many different surroundings
MIN_Z = 6.0  # and is guilty so many standard deviations more often than its frequency explains
EPOCHS, RATE, DECAY, BIAS = 600, 0.3, 0.002, -7.0
PREDICTED = 0.3

_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".!?\n"]] = 1
_TOP = np.uint64(64 - 18)


class Sentences:
    """first: each sentence's first word (k + 1 places); of: each text's first sentence (n + 1 places)."""

    def __init__(self, chunk: Chunk):
        self.low, self.offsets = words.fold(chunk.data), chunk.offsets
        w = self.words = words.Words(chunk.data, chunk.offsets, self.low)
        n = len(w.start)
        text = self.text = np.repeat(np.arange(len(chunk)), np.diff(w.first))
        stops = np.cumsum(_STOP[chunk.data])[w.start] if n else np.zeros(0, np.int64)
        begins = np.ones(n, bool)
        begins[1:] = (text[1:] != text[:-1]) | (stops[1:] != stops[:-1])
        head = np.flatnonzero(begins)
        self.first = np.append(head, n)
        self.sentence = np.cumsum(begins) - 1
        self.of = np.searchsorted(head, w.first)
        # features by word: the word, and the pair with the next word of its sentence
        self.one = (w.hash >> _TOP).astype(np.int32)
        self.two = np.full(n, 2 * FEATURES, np.int32)
        inside = np.flatnonzero(~begins[1:]) if n else np.zeros(0, np.int64)
        self.two[inside] = (words.mix(w.hash[inside] * np.uint64(3) + w.hash[inside + 1]) >> _TOP).astype(np.int32)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Features of the parts of words, and the word of each. A gap stands before and after every text."""
        w, sizes = self.words, np.diff(self.offsets)
        n = len(self.low) + len(sizes) + 1
        if n < GRAM or not len(w.start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        at = np.arange(len(self.low)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
        low = np.zeros(n, np.uint64)
        low[at] = self.low
        own = np.zeros(n + 1, np.int32)  # number of the word that covers a byte, from 1; 0: none
        own[at[w.start]] += np.arange(1, len(w.start) + 1, dtype=np.int32)
        own[at[w.end - 1] + 1] -= np.arange(1, len(w.start) + 1, dtype=np.int32)
        own = np.cumsum(own[:n], dtype=np.int32)
        sym = np.where(own > 0, low, np.uint64(0))
        m = n - GRAM + 1
        h = np.zeros(m, np.uint64)
        for j in range(GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) + sym[j:j + m] + np.uint64(1)
        inner = own[1:1 + m]
        ok = (inner > 0) & (own[GRAM - 2:GRAM - 2 + m] == inner)
        for edge in (own[:m], own[GRAM - 1:]):
            ok &= (edge == 0) | (edge == inner)
        at = np.flatnonzero(ok)
        return ((words.mix(h[at]) >> _TOP).astype(np.int32) + FEATURES), inner[at].astype(np.int64) - 1


def _cases(feats: np.ndarray, keys: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By feature: distinct keys, and how many of them occur in toxic texts only."""
    order = np.lexsort((toxic, keys))
    first = np.ones(len(keys), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    case = order[first]  # the least label of each key
    return np.bincount(feats[case], minlength=SIZE), np.bincount(feats[case], toxic[case], SIZE)


def _telling(cases: np.ndarray, guilty: np.ndarray) -> np.ndarray:
    share = guilty.sum() / max(cases.sum(), 1)
    z = (guilty - cases * share) / np.sqrt(np.maximum(cases, 1) * max(share * (1 - share), 1e-9))
    return (cases >= MIN_CASES) & (z >= MIN_Z)


def _screen(chunks: list[Chunk], label: np.ndarray) -> np.ndarray:
    """Which features speak for label 1.

    What counts is distinct surroundings, so copies of a text add nothing: a word or
    pair after one and the same word is one case, a part of a word in one and the same
    word is one case, and a case is guilty if all its texts are toxic.
    """
    hashes, befores, ones, twos, toxic = [], [], [], [], []
    at = 0
    for c in chunks:
        s = Sentences(c)
        before = np.zeros(len(s.text), np.uint64)
        before[1:] = np.where(np.diff(s.text) == 0, s.words.hash[:-1], np.uint64(0))
        for to, x in zip((hashes, befores, ones, twos, toxic), (s.words.hash, before, s.one, s.two, label[at + s.text])):
            to.append(x)
        at += len(c)
    h, before, one, two, y = map(np.concatenate, (hashes, befores, ones, twos, toxic))
    used = np.zeros(SIZE, bool)
    for f in (one, two):
        cases, guilty = _cases(f, words.mix(before) ^ words.mix(f.astype(np.uint64) + np.uint64(1)), y)
        cases[2 * FEATURES] = guilty[2 * FEATURES] = 0
        used |= _telling(cases, guilty)
    kinds, first, number = np.unique(h, return_index=True, return_inverse=True)
    blame = np.ones(len(kinds), np.int64)
    np.minimum.at(blame, number, y)
    where = np.zeros(len(h), bool)
    where[first] = True
    cases, guilty, at = np.zeros(SIZE), np.zeros(SIZE), 0
    for c in chunks:
        s = Sentences(c)
        f, word = s.parts()
        new = where[at + word]
        f, word = f[new], word[new]
        cases += np.bincount(f, minlength=SIZE)
        guilty += np.bincount(f, blame[number[at + word]], SIZE)
        at += len(s.text)
    return used | _telling(cases, guilty)


def _fit(chunks: list[Chunk], label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (SIZE places) and bias, by Adagrad over all texts at once."""
    used = np.flatnonzero(_screen(chunks, label))
    number = np.full(SIZE, -1)
    number[used] = np.arange(len(used))
    feats, sents, text_of, n_sent, at = [], [], [], 0, 0
    for c in chunks:
        s = Sentences(c)
        f, word = s.parts()
        f = np.concatenate([s.one, s.two, f])
        of = np.concatenate([s.sentence, s.sentence, s.sentence[word]])
        keep = number[f] >= 0
        feats.append(number[f[keep]])
        sents.append(n_sent + of[keep])
        text_of.append(at + np.repeat(np.arange(len(c)), np.diff(s.of)))
        n_sent += len(s.first) - 1
        at += len(c)
    feats, sents, text_of = map(np.concatenate, (feats, sents, text_of))
    w, b = np.zeros(len(used)), BIAS
    gw, gb = np.full(len(used), 1e-8), 1e-8
    toxic = label[text_of] == 1
    n = max(len(label), 1)
    for _ in range(EPOCHS):
        z = np.clip(np.bincount(sents, w[feats], n_sent) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(text_of, -np.logaddexp(0, z), len(label)))  # 1 - P of a text
        blame = np.where(toxic, -(clean / np.maximum(1 - clean, 1e-12))[text_of], 1.0) * p / n
        g = np.bincount(feats, blame[sents], len(used)) + DECAY * w / n
        gw += g * g
        w -= RATE * g / np.sqrt(gw)
        g = blame.sum()
        gb += g * g
        b -= RATE * g / np.sqrt(gb)
    out = np.zeros(SIZE)
    out[used] = w
    return out, float(b)


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
          max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """Model of a bounded sample, fitted in one task. Rows with a null text or label teach nothing.

    Without any row of either label the weights are zero and the bias says which one is known.
    """
    rows = labelled.where(col(label).isNotNull() & col(text).isNotNull())
    sample = bounded_sample(rows, key, text, max_rows, max_bytes)

    def fit(batches):
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        y = got.column(1).to_numpy() if got is not None else np.zeros(0, np.int32)
        if len(set(y.tolist())) < 2:
            w, b = np.zeros(SIZE), (4.0 if 1 in y else -8.0)
        else:
            order = np.lexsort((got.column(2).to_numpy(),))
            got = got.take(order)
            w, b = _fit(list(text_chunks(got.column(0).combine_chunks())), got.column(1).to_numpy())
        hit = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(w[hit], b))], names=["f", "w"])

    fitted = (sample.select(col(text), col(label).cast("int"), F.xxhash64(col(key)).alias("k"))
              .repartition(1).mapInArrow(fit, "f int, w double").toPandas())
    w, b = np.zeros(SIZE), -8.0
    if len(fitted):
        at = fitted["f"].to_numpy()
        w[at[at >= 0]] = fitted["w"].to_numpy()[at >= 0]
        b = float(fitted["w"].to_numpy()[at == -1][0])
    return w, b


def score_texts(spark: SparkSession, docs: DataFrame, model, text: str = "text", threshold: float = PREDICTED) -> DataFrame:
    """docs with ``score`` (noisy-or, 0 to 1), ``predicted`` (score at least threshold) and ``offending``.

    ``offending`` lists (start, end, score) of each sentence whose own probability
    reaches the threshold; places are code points, end exclusive. A null or empty text
    has no sentence and scores 0. Columns of those names are replaced; all rows stay.
    """
    shared = spark.sparkContext.broadcast(model)

    def maker():
        w, b = shared.value

        def run(chunk: Chunk):
            s = Sentences(chunk)
            f, word = s.parts()
            f = w[f]
            hit = np.flatnonzero(f)
            z = words.sums_by(w[s.one] + w[s.two], s.first) + b
            z += np.bincount(s.sentence[word[hit]], f[hit], len(z))
            z = np.clip(z, -30, 30)
            total = 1 - np.exp(words.sums_by(-np.logaddexp(0, z), s.of))
            p = 1 / (1 + np.exp(-z))
            bad = np.flatnonzero(p >= threshold)
            heads = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))
            text_of = np.searchsorted(s.of, bad, "right") - 1
            base = heads[chunk.offsets[text_of]]
            start = heads[s.words.start[s.first[bad]]] - base
            end = heads[s.words.end[s.first[bad + 1] - 1]] - base
            at = np.searchsorted(text_of, np.arange(len(chunk) + 1))
            found = pa.StructArray.from_arrays([pa.array(start), pa.array(end), pa.array(p[bad])], names=["start", "end", "score"])
            return [pa.array(total), pa.array((total >= threshold).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), found)]
        return run

    return with_text_columns(
        docs, text, "score double, predicted int, offending array<struct<start:bigint,end:bigint,score:double>>", maker)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 4) == 2
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic").where("toxic is not null")
    model = train(labelled_sample(docs, labels, "doc_id", MAX_ROWS))
    return score_texts(spark, docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")
