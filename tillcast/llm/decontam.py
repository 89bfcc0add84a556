"""Benchmark decontamination: every passage of a text is a BM25 query over the test items.

Items become inverted indexes whose postings are cut into blocks of items with the
greatest impact of each term in each block (block-max). A passage is dropped as soon as a
bound shows that it cannot reach any item's threshold: first by the terms' greatest
impacts, then block by block; what is left is scored in full. Passages are handled side
by side in arrays rather than one cursor at a time. Document frequencies and the mean
length are those of all items.

A passage is as long as the item sought asks for: items are indexed by the power of two
above their length, and each index has passages of its own. An item's threshold is its own
full score less what a passage may lack and still hold ``OVERLAP`` of the item's five-word
shingles, so retrieval misses no such passage. Retrieved pairs are then verified: overall
by ``OVERLAP``, and question and answer each by ``PART``. What is found of an item
therefore does not depend on the other items.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import words
from .common import Chunk, Scratch, col, fresh, read, with_text_columns

K1, B = 1.2, 0.75
SHINGLE, OVERLAP = 5, 0.8
PART = 0.5  # of the shingles of the question, and of the answer
BLOCK = 8  # items to a block of postings
GROUP = 512  # passages looked up side by side
SHARD_ITEMS = 4096  # an index holds at most so many items
PASS_BYTES = 32 << 20  # items of about so many bytes are sought in one pass over the texts
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType())] + [
    T.StructField(c, T.DoubleType()) for c in ("score", "threshold", "overlap", "question", "answer")]))


def answer_start(text: str) -> int | None:
    """Where an item's answer begins: after "answer:", else after the last question mark
    that text follows. None: question and answer cannot be told apart."""
    marks = list(re.finditer(r"(?i)\banswer\s*:", text))
    if marks:
        return marks[-1].end()
    ends = [m.end() for m in re.finditer(r"\?(?=.*\w)", text, re.S)]
    return ends[-1] if ends else None


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """Hash of each run of SHINGLE words; a shorter text is one shingle."""
    n = len(hashes)
    width = min(SHINGLE, n)
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        out = words.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + len(out)])
    return out


def words_of(texts: list[str]) -> tuple[words.Words, np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return words.Words(np.frombuffer(b"".join(raw) or b" ", np.uint8)[:offsets[-1]], offsets), offsets


def length_class(n_words: int) -> int:
    """Items of a class have fewer than 2 ** class words."""
    return int(n_words).bit_length()


class Index:
    """Inverted index of items (id, text) of one length class.

    ``terms``: sorted term hashes, ``df``: how many of all ``n_all`` items hold each;
    ``mean``: words of an item on average.
    """

    def __init__(self, items: list[tuple[int, str]], terms: np.ndarray, df: np.ndarray, n_all: int, mean: float):
        w, offsets = words_of([t for _, t in items])
        n = len(items)
        own = [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
        self.ids = [i for i, _ in items]
        self.shingles = [_shingles(h) for h in own]
        self.answer = []  # first shingle whose last word belongs to the answer; None: all belong to both
        for (_, text), a, b, o in zip(items, w.first, w.first[1:], offsets):
            at = answer_start(text)
            question = 0 if at is None else int(np.searchsorted(w.start[a:b] - o, len(text[:at].encode())))
            self.answer.append(max(question - min(SHINGLE, b - a) + 1, 0) if 0 < question < b - a else None)
        length = np.diff(w.first)
        self.step = max(32, -(-5 * 2 ** max(map(length_class, length), default=0) // 4))
        self.n_terms = len(terms)
        item = np.repeat(np.arange(n), length)
        key, tf = np.unique(np.searchsorted(terms, w.hash) * n + item, return_counts=True)
        term, item = key // n, key % n  # postings, by term then item
        idf = np.log1p((n_all - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[item])
        self.threshold = np.zeros(n)
        for i, mine in enumerate(np.split(impact[np.argsort(item, kind="stable")], np.cumsum(np.bincount(item, minlength=n))[:-1])):
            mine = np.sort(mine)[::-1]
            self.threshold[i] = max(mine.sum() - mine[:int((1 - OVERLAP) * len(self.shingles[i]) + 1e-9)].sum() - 1e-9, 1e-9)
        share = impact / self.threshold[item]
        self.item, self.impact, self.at = item, impact, np.searchsorted(term, np.arange(self.n_terms + 1))
        block = item // BLOCK
        head = np.ones(len(term), bool)
        head[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(head)
        self.n_blocks = -(-n // BLOCK)
        self.block, self.block_at = block[first], np.searchsorted(term[first], np.arange(self.n_terms + 1))
        self.block_max = np.maximum.reduceat(share, first) if len(first) else np.zeros(0)
        self.most = np.zeros(self.n_terms)
        np.maximum.at(self.most, term, share)

    def search(self, w: words.Words, known: np.ndarray, term: np.ndarray) -> list[tuple]:
        """(text, item, score, overlap, question, answer) of verified pairs, best passage of each.

        ``known``: the words that are terms, ``term``: their numbers.
        """
        here = self.most[term] > 0
        known, term = known[here], term[here]
        if not len(known):
            return []
        count = np.diff(w.first)
        halves = -(-count // self.step)
        half0 = np.concatenate(([0], np.cumsum(halves)))
        text = np.searchsorted(w.first, known, "right") - 1
        half = half0[text] + (known - w.first[text]) // self.step
        n_half = int(half0[-1])
        last = np.zeros(n_half, bool)
        last[half0[1:][halves > 0] - 1] = True
        n_terms = self.n_terms
        # repeated terms raise a bound; where even that is too low nothing is sorted
        loose = np.bincount(half, self.most[term], n_half)
        open_half = loose + np.where(last, 0, np.append(loose[1:], 0)) >= 1
        open_half[1:] |= open_half[:-1] & ~last[:-1]
        some = open_half[half]
        pairs = np.unique(half[some] * n_terms + term[some])
        half, term = pairs // n_terms, pairs % n_terms
        # a passage is a half and the next of the same text
        bound = np.bincount(half, self.most[term], n_half)
        both = bound + np.where(last, 0, np.append(bound[1:], 0))
        alive = np.flatnonzero(both >= 1)
        if not len(alive):
            return []
        cut = np.searchsorted(half, np.arange(n_half + 2))
        out: dict[tuple[int, int], tuple] = {}
        for at in range(0, len(alive), GROUP):
            group = alive[at:at + GROUP]
            stop = np.where(last[group], cut[group + 1], cut[np.minimum(group + 2, n_half)])
            passage, rows = _expand(cut[group], stop)
            t = term[rows]
            passage, t = np.divmod(np.unique(passage * n_terms + t), n_terms)
            owner, places = _expand(self.block_at[t], self.block_at[t + 1])
            blocks = np.bincount(passage[owner] * self.n_blocks + self.block[places], self.block_max[places], len(group) * self.n_blocks)
            open_blocks = blocks >= 1
            owner, places = _expand(self.at[t], self.at[t + 1])
            keep = open_blocks[passage[owner] * self.n_blocks + self.item[places] // BLOCK]
            owner, places = owner[keep], places[keep]
            n = len(self.ids)
            hit, where = np.unique(passage[owner] * n + self.item[places], return_inverse=True)
            score = np.bincount(where, self.impact[places], len(hit))
            for h, s in zip(hit.tolist(), score.tolist()):
                p, i = divmod(h, n)
                if s < self.threshold[i]:
                    continue
                g = int(group[p])
                x = int(np.searchsorted(half0, g, "right")) - 1
                a = w.first[x] + (g - half0[x]) * self.step
                held = np.isin(self.shingles[i], _shingles_of(w.hash[a:min(a + 2 * self.step, w.first[x + 1])], len(self.shingles[i]), self.step))
                answer = self.answer[i]
                q, r = (held, held) if not answer else (held[:answer], held[answer:])
                if held.mean() >= OVERLAP and q.mean() >= PART and r.mean() >= PART:
                    found = (float(held.mean()), s, float(q.mean()), float(r.mean()))
                    out[x, i] = max(out.get((x, i), found), found)
        return [(x, i, s, o, q, r) for (x, i), (o, s, q, r) in sorted(out.items())]


def _shingles_of(hashes: np.ndarray, n_item: int, step: int) -> np.ndarray:
    """Shingles of a passage; when the item is one short shingle, of every shorter width too."""
    if n_item > 1:
        return _shingles(hashes)
    out = []
    for width in range(1, SHINGLE + 1):
        m = len(hashes) - width + 1
        if m > 0:
            h = np.zeros(m, np.uint64)
            for j in range(width):
                h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + m])
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the ranges start..stop, and the number of the range it comes from."""
    size = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(start)), size)
    return owner, np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size)


def _terms(batches):
    """(i, t, n_words, terms): the different words of each item, hashed."""
    for batch in batches:
        w, _ = words_of(batch.column("t").to_pylist())
        own = [np.unique(w.hash[a:b]).view(np.int64) for a, b in zip(w.first, w.first[1:])]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))), pa.int32()),
                                         pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
        yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("t"), pa.array(np.diff(w.first), pa.int64()), lists],
                                         names=["i", "t", "n_words", "terms"])


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               name: str = "leaks") -> DataFrame:
    """docs with column ``name``: the items found in each text, with score and overlaps.

    Words are runs of letters and digits in lower case. An item without words is never
    found; one of fewer than five words is one shingle. An item with "answer:" or a
    question mark inside needs both parts, any other is question and answer in one. A null
    or empty text has no leaks. Repeated items are found each. A column of docs called
    ``name`` is replaced; every row is kept. Items go through the driver PASS_BYTES at a
    time, and each such share costs one pass over the texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    test = items.where(col(item_text).isNotNull() & col(item_id).isNotNull()).select(
        col(item_id).cast("long").alias("i"), col(item_text).alias("t"))
    test = scratch.keep(test.mapInArrow(_terms, "i long, t string, n_words long, terms array<long>").where("n_words > 0"))
    n, size, mean = test.agg(F.count(F.lit(1)), F.sum(F.octet_length("t")), F.avg("n_words")).first()
    passes = max(-(-(size or 0) // PASS_BYTES), 1)
    counted = scratch.keep(test.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    out = docs.select(*[col(c) for c in docs.columns if c != name])
    parts = [fresh(docs, f"__leaks{k}") for k in range(passes)]
    for k in range(passes):
        part = test.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k) if passes > 1 else test
        rows = part.select("i", "t", "n_words").orderBy("i", "t").collect()
        used = counted.join(part.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").toPandas()
        terms = used.term.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(terms)
        terms, df = terms[order], used["df"].to_numpy(float)[order]
        classes: dict[int, list[tuple[int, str]]] = {}
        for r in rows:
            classes.setdefault(length_class(r.n_words), []).append((r.i, r.t))
        indexes = [Index(own[at:at + SHARD_ITEMS], terms, df, n, mean) for _, own in sorted(classes.items()) for at in range(0, len(own), SHARD_ITEMS)]
        out = _search(spark, out, terms, indexes, text, parts[k])
    return out.select(*[col(c) for c in docs.columns if c != name], F.concat(*parts).alias(name))


def _search(spark: SparkSession, docs: DataFrame, terms: np.ndarray, indexes: list[Index], text: str, name: str) -> DataFrame:
    shared = spark.sparkContext.broadcast((terms, indexes))  # bounded by PASS_BYTES

    def maker():
        terms, indexes = shared.value
        kind = pa.struct([("item_id", pa.int64())] + [(c, pa.float64()) for c in ("score", "threshold", "overlap", "question", "answer")])

        def run(chunk: Chunk):
            found = []
            if len(terms):
                w = words.Words(chunk.data, chunk.offsets)
                term = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
                known = np.flatnonzero(terms[term] == w.hash)
                found = sorted(((x, index.ids[i], {"item_id": index.ids[i], "score": s, "threshold": float(index.threshold[i]), "overlap": o, "question": q, "answer": r})
                               for index in indexes for x, i, s, o, q, r in index.search(w, known, term[known])), key=lambda f: f[:2])
            at = np.searchsorted([f[0] for f in found], np.arange(len(chunk) + 1))
            return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array([f[2] for f in found], kind))]
        return run

    return with_text_columns(docs, text, T.StructType([T.StructField(name, LEAK)]), maker)


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each text and test item found in it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
