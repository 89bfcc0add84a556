"""Spelling variants: words one edit apart, found by blocked Gram matrices.

A word's letter counts are a vector. Two words one edit apart lie at a squared distance
of 1 (a letter more) or 2 (one letter for another), and numpy products of blocks of such
vectors give all squared distances of a block at once. Pairs at most two apart in blocks
of the same or of adjacent lengths are kept, and the edit is verified on the letters.

Blocks are cut finer than by length, so that their products stay far from the square of
the vocabulary: the letters fall into CLASSES classes, and a word's profile is how many
it has of each. One edit takes a letter out of one class and may put one into another.
A word therefore stands in the block of its own profile as the shorter word, and in the
block of each profile with one letter less as the longer; two words one edit apart meet
as shorter and longer, or as two longer ones, and just once count there. A block of
more than TILE words is cut into tiles, and every two tiles meet in a task of their own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, col, read, small_batches, text_chunks

WORD = re.compile("[a-zÀ-ÿ]+")
MIN_LETTERS, MIN_COUNT, RATIO, EVERY = 7, 2, 10, 31
CLASSES, TILE, BLOCK = 12, 1024, 256
HELD = 200_000  # distinct words a task holds before it passes on their counts
LETTERS = 26 + 64  # a to z, U+00C0 to U+00FF


def _counted(min_letters: int, every: int):
    """Rows (word, n): occurrences of the words of a task's texts, added up as far as HELD words."""
    def run(batches):
        total: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for c in text_chunks(batch.column(1)):
                raw, o = c.data.tobytes().lower(), c.offsets.tolist()  # of bytes: A-Z only
                for k, (a, b) in enumerate(zip(o, o[1:])):
                    seed = zlib.crc32(f"{ids[c.start + k] or ''}:".encode())
                    for w, n in Counter(WORD.findall(raw[a:b].decode())).items():
                        if len(w) < min_letters:
                            continue
                        h = zlib.crc32(w.encode(), seed)
                        if every and h % every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < min_letters:
                                continue
                        total[w] += n
                    if len(total) >= HELD:
                        yield flush()
        if total:
            yield flush()
    return run


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS,
               min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z in lower case, with their occurrences.

    Of a run whose crc32 with its document's id is divisible by ``every`` the letter
    at that hash is left out first (0: never). Words of fewer letters or occurrences
    than asked for are left out. A null doc_id counts as the empty text; a null text
    has no words; repeated rows count each time.
    """
    src = docs.select(col(doc_id).cast("string").alias("doc_id"), col(text).alias("text"))
    small_batches(docs.sparkSession)
    words = src.mapInArrow(_counted(min_letters, every), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(words: list[bytes]) -> np.ndarray:
    """A row for each word (Latin-1 bytes), a column for each letter: how often it holds it."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    letter = np.where(flat < 128, flat - 97, flat - 0xC0 + 26)
    row = np.repeat(np.arange(len(words)), size)
    exact = np.float32 if not len(size) or size.max() <= 2000 else np.float64  # squares of counts stay whole numbers
    return np.bincount(row * LETTERS + letter, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(exact)


# Class of each letter: dealt in turn by how common letters are in Latin-script prose, the rest by their place.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
CLASS = np.array([_COMMON.index(chr(97 + i)) % CLASSES if i < 26 else i % CLASSES for i in range(LETTERS)])
# A profile's key is linear in its counts: one letter less of a class is one subtraction. Equal keys of unequal profiles cost time only.
_STEP = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3 | 1) % (1 << 64) for k in range(1, CLASSES + 1)], np.uint64)


def _keyed(batches):
    """(key, part, word, n): part -1 under the own profile, else the class of the letter taken out."""
    hot = np.zeros((LETTERS, CLASSES), np.float64)
    hot[np.arange(LETTERS), CLASS] = 1
    for batch in batches:
        if not batch.num_rows:
            continue
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        profile = (_letters(words) @ hot).astype(np.uint64)
        own = (profile * _STEP).sum(axis=1, dtype=np.uint64)
        row, part = np.nonzero(profile)
        at = np.concatenate((np.arange(len(words)), row))
        key = np.concatenate((own, own[row] - _STEP[part])).view(np.int64)
        part = np.concatenate((np.full(len(words), -1), part))
        rows = batch.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part, pa.int32()), rows.column("word"), rows.column("n")],
                                         names=["key", "part", "word", "n"])


def one_edit(words: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of Latin-1 words are one edit apart, words[i] the longer or as long."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ok = np.zeros(len(i), bool)
    width = int(max(size[i].max(initial=0), size[j].max(initial=0))) + 1
    step = max(1, (1 << 22) // width)
    for lo in range(0, len(i), step):
        a, b = i[lo:lo + step], j[lo:lo + step]
        used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        letters = np.array([words[k] for k in used.tolist()], f"S{width}").view(np.uint8).reshape(-1, width)
        x, y = letters[at[:len(a)]], letters[at[len(a):]]
        longer = size[a] - size[b]
        differ = x != y
        after = np.arange(width - 1)[None, :] >= differ.argmax(axis=1)[:, None]
        shifted = ~((x[:, 1:] != y[:, :-1]) & after).any(axis=1)
        ok[lo:lo + step] = np.where(longer == 0, differ.sum(axis=1) == 1, (longer == 1) & shifted)
    return ok


def _near_in(group: np.ndarray, tile: np.ndarray, whole: np.ndarray, part: np.ndarray, words: list[bytes]):
    """Index pairs (i, j) of words one edit apart in blocks laid side by side; i the longer or as long.

    ``whole``: the two tiles of the block are one, else only pairs across tiles count.
    """
    counts = _letters(words)
    letters = np.flatnonzero(counts.any(axis=0))
    counts = counts[:, letters]
    square, one = np.einsum("ij,ij->i", counts, counts)[:, None], np.ones((len(words), 1), counts.dtype)
    distance = np.hstack((counts, square, one)) @ np.hstack((-2 * counts, one, square)).T
    i, j = np.nonzero(distance <= 2)
    some = (i < j) & (group[i] == group[j])
    i, j = i[some], j[some]
    longer = part >= 0
    fits = np.where(longer[i] & longer[j], 2, np.where(longer[i] | longer[j], 1, -1)) == distance[i, j]
    fits &= whole[i] | (tile[i] != tile[j])
    i, j = i[fits], j[fits]
    swap = ~longer[i]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    # two words of one profile meet under every class they have; they count where the letter that goes is of that class
    gone = letters[(counts[i] - counts[j]).argmax(axis=1)] if len(i) else i
    here = ~longer[j] | (CLASS[gone] == part[i])
    i, j = i[here], j[here]
    ok = one_edit(words, i, j)
    return i[ok], j[ok]


def _pairs(batches):
    """(word, near, near_n) both ways, from rows in order of (key, t, u)."""
    held: list[pa.RecordBatch] = []
    have = 0

    def emit(table: pa.Table):
        key, t, u, tile, part, n = (table.column(c).to_numpy() for c in ("key", "t", "u", "tile", "part", "n"))
        new = np.flatnonzero((key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1])) + 1
        starts = np.concatenate(([0], new, [len(key)]))
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        text = table.column("word").combine_chunks()
        words = [w.encode("latin-1") for w in text.to_pylist()]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        many = lo = 0
        while lo < len(starts) - 1:
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK, "right")) - 1)
            a, b = int(starts[lo]), int(starts[hi])
            lo = hi
            if b - a > 1:
                i, j = _near_in(group[a:b], tile[a:b], t[a:b] == u[a:b], part[a:b], words[a:b])
                found += [(i + a, j + a), (j + a, i + a)]
                many += len(i)
            if found and (many >= 1 << 16 or lo == len(starts) - 1):
                own, other = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([text.take(pa.array(own)), text.take(pa.array(other)), pa.array(n[other])], names=["word", "near", "near_n"])
                found, many = [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        have += batch.num_rows
        if have < 1 << 15:
            continue
        table = pa.Table.from_batches(held)
        key, t, u = (table.column(c).to_numpy() for c in ("key", "t", "u"))
        last = np.flatnonzero((key != key[-1]) | (t != t[-1]) | (u != u[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last block may go on
        if cut:
            yield from emit(table.slice(0, cut))
        held, have = table.slice(cut).to_batches(), table.num_rows - cut
    if have:
        yield from emit(pa.Table.from_batches(held))


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n): all pairs of words one edit apart, each both ways, once.

    ``words`` is (word, n), each word once, of the letters a to z and U+00C0 to U+00FF.
    ``tile`` changes cost, not results.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    keyed = scratch.keep(words.select("word", "n").mapInArrow(_keyed, "key long, part int, word string, n long"))
    large = scratch.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile))
    tiles = F.coalesce(F.ceil(F.col("size") / tile), F.lit(1)).cast("int")
    cut = keyed.join(large, "key", "left").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    met = cut.select("key", "part", "word", "n", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("to"))
    met = met.select("key", F.least("tile", "to").alias("t"), F.greatest("tile", "to").alias("u"), "tile", "part", "word", "n")
    return met.repartition("key", "t", "u").sortWithinPartitions("key", "t", "u").mapInArrow(_pairs, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along its form to the last.

    ``forms`` is (word, form), each word once, and leads nowhere back. The way left to go
    is halved in each round, in which only words whose form goes on are joined.
    """
    scratch = Scratch(forms.sparkSession, "roots")
    now = scratch.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.keep(now.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word.

    ``form`` is the near word of most occurrences, ties to the smallest, if it has
    ``ratio`` times the word's or more, else null; ``root`` is the last form reached, the
    word itself without one. No words give no rows.
    """
    scratch = Scratch(words.sparkSession, "variants")
    words = scratch.keep(words.select("word", "n"))
    best = near_words(words, tile).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    table = scratch.keep(words.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n")))
    last = roots(table.where("form is not null").select("word", "form"))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(read(spark, sf_dir, "documents")))
