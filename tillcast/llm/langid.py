"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample by language in tasks and sums the counts
in Spark. The matrix of log-probabilities (2^16 features by languages) is broadcast;
a batch is scored by gathering the rows of its n-grams and summing them by text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import words
from .common import Chunk, col, crc_mod, read, sample_by_label, text_chunks, with_text_columns

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
MAX_ROWS, MAX_BYTES = 20_000, 64 << 20  # the training sample: at most about this many rows and bytes, an equal part for each label
MAX_LABELS = 256  # a matrix of FEATURES by labels is broadcast: 134 MB
UNKNOWN = "und"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case (if that is one code point)."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return letter, lower


def _grams(chunk: Chunk) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature ids of each order by first place (FEATURES: none there), text starts, letters by text."""
    whole, starts = chunk.chars()
    cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, lower = _tables()
    is_letter = letter[cps]
    sym = np.where(is_letter, lower[cps], np.uint32(0))
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(cps))  # symbols to the end of the text
    out = []
    for n in ORDERS:
        m = max(len(sym) - n + 1, 0)
        h = np.full(m, n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
        any_letter = np.zeros(m, bool)
        for j in range(n):
            h = (h ^ sym[j:j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            any_letter |= is_letter[j:j + m]
        ok = any_letter & (left[:m] >= n)
        if n > 2:  # one gap at most
            ok &= is_letter[1:m + 1]
        f = np.full(len(sym), FEATURES, np.int64)
        f[:m][ok] = (h >> np.uint32(16))[ok]
        out.append(f)
    return out, starts, words.sums_by(is_letter.astype(np.int64), starts)


def train(labelled: DataFrame, text: str = "text", label: str = "lang", alpha: float = 0.5,
          max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, key: str = "doc_id"):
    """(labels, log-probabilities [FEATURES + 1, labels], log priors).

    Rows with a null label or text teach nothing. Without any, labels is empty. A label's
    prior is its share of all rows with a label, whatever the sample took of it.
    """
    rows = labelled.where(col(label).isNotNull() & col(text).isNotNull())
    sample, known = sample_by_label(rows, key, text, label, max_rows, max_bytes, MAX_LABELS)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for chunk in text_chunks(batch.column(0)):
                names = batch.column(1).slice(chunk.start, len(chunk)).to_pylist()
                grams, starts, _ = _grams(chunk)
                kinds = sorted(set(names))
                number = np.repeat([kinds.index(x) for x in names], np.diff(starts)).astype(np.int64)
                width = FEATURES + 1
                got = np.zeros(width * len(kinds), np.int64)
                for g in grams:
                    got += np.bincount(number * width + g, minlength=len(got))
                for i, k in enumerate(kinds):
                    part = got[i * width:(i + 1) * width].copy()
                    part[FEATURES] = 0  # places without a feature
                    sums[k] = sums[k] + part if k in sums else part
        for k, v in sums.items():
            hit = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(v[hit], pa.int64())],
                names=["label", "f", "n"])

    counts = (sample.select(col(text), col(label).cast("string"))
              .mapInArrow(count, "label string, f int, n long")
              .groupBy("label", "f").agg(F.sum("n").alias("n")).toPandas())  # labels x FEATURES rows at most
    labels = sorted(known)
    n = np.zeros((FEATURES + 1, len(labels)))
    for j, name in enumerate(labels):
        one = counts[counts["label"] == name]
        n[one["f"].to_numpy(), j] = one["n"].to_numpy()
    docs, n = np.array([known[k] for k in labels], float), n[:FEATURES] + alpha
    logp = np.vstack([np.log(n / n.sum(axis=0)), np.zeros(len(labels))])
    return labels, logp, np.log(docs / docs.sum()) if len(labels) else np.zeros(0)


def identify(spark: SparkSession, docs: DataFrame, model, text: str = "text",
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its posterior probability (0 to 1), called by ``names``.

    ``und`` with score 0 if the text is null, empty or without a letter, and if the
    model knows no label. Equal posteriors go to the label that sorts first. Columns
    of docs with those names are replaced; every row is kept.
    """
    shared = spark.sparkContext.broadcast(model)

    def maker():
        labels, logp, prior = shared.value

        def score(chunk: Chunk):
            if not labels:
                return [pa.array([UNKNOWN] * len(chunk)), pa.array([0.0] * len(chunk))]
            grams, starts, letters = _grams(chunk)
            total = prior + sum(words.sums_by(logp[g], starts) for g in grams)
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total[np.arange(len(total)), best][:, None]).sum(axis=1)
            known = letters > 0
            return [pa.array([labels[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, p, 0.0))]
        return score

    schema = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return with_text_columns(docs, text, schema, maker)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    model = train(docs.where(~held_out))
    found = identify(spark, docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
