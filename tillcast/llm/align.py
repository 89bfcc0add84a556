"""Two tokenizers of one text aligned, and how often their tokens are linked.

Both tokenizers cut the bytes of a text into tokens. Offsets where tokens of both end
are shared cuts; between two of them lies a group of tokens that cover the same bytes.
The cuts are found by divide and conquer: in an interval, the end of a token near the
middle is sought among the other tokenizer's ends by bisection, then its neighbours
outwards; at a shared cut the interval is halved, and one without a cut is a group.

Links of a corpus are counted in blocks. A task lists the different id pairs of BLOCK
bytes of text once, with the number of documents that hold each, beside documents that
name their pairs by place in that list. Only the lists are shuffled to be added up, so
that a pair in every document costs a row a block; sums go back to their blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .bpe import load_ranks
from .common import Scratch, col, read, small_batches, text_chunks, with_text_columns

PROBES = 8  # ends tried one after another around the middle; then all of an interval are
BLOCK = 1 << 23  # bytes of text whose pairs are listed together; a longer text is a block of its own
WIDE = 4096  # links of a group beyond which its ids are counted first
TEXT = 1 << 20  # bytes of text encoded at once


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


# Code points whose letter, number and space classes are the same in every version of Unicode that tokenizers carry.
_SETTLED = re.compile("[^\x00-\u024f]")


class Tokenizers:
    """A byte-level BPE and a piece model, and the bytes of each of their tokens.

    ``byte_ranks`` may name the byte-level vocabulary as ranks as well. Texts of settled
    code points alone are then encoded from the ranks, which gives the same ids faster;
    a file of another vocabulary is refused.
    """

    def __init__(self, byte_json: str, piece_model: str, byte_ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_json)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.ranks = None
        if byte_ranks:
            import public_tokenizers
            import tiktoken
            ranks = load_ranks(byte_ranks)
            special = {self.a.token_to_id(t.content) for t in self.a.get_added_tokens_decoder().values()}
            if ranks != {t: i for i, t in enumerate(self.bytes_a) if i not in special}:
                raise ValueError("the ranks are not those of the vocabulary")
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list, list[list[int]]]:
        """Ids of both for each text; none for an empty text or where either's bytes are not those of a space and the text."""
        a: list = [None] * len(texts)
        if self.ranks:
            for k, t in enumerate(texts):
                if not _SETTLED.search(t):
                    a[k] = self.ranks.encode_ordinary(" " + t)
        rest = [k for k, ids in enumerate(a) if ids is None]
        for k, e in zip(rest, self.a.encode_batch_fast([" " + texts[k] for k in rest], add_special_tokens=False)):
            a[k] = e.ids
        b = self.b.encode(texts, num_threads=1)
        at_a, at_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for k, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or b"".join(map(at_a, a[k])) != want or b"".join(map(at_b, b[k])) != want:
                a[k], b[k] = [], []
        return a, b


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (a, b) of every shared cut, in order.

    Ends are byte offsets that grow through all texts; text i has the tokens first[i] to
    first[i + 1], and its last two end together.
    """
    full = np.flatnonzero(np.diff(first_a) > 0)
    done_a, done_b = [first_a[full + 1] - 1], [first_b[full + 1] - 1]
    lo, hi, blo, bhi = first_a[full], first_a[full + 1], first_b[full], first_b[full + 1]
    probe = np.zeros(len(lo), np.int64)
    while len(lo):
        inner = (hi - lo > 1) & (bhi - blo > 1) & (probe < hi - lo - 1)  # the rest are groups
        lo, hi, blo, bhi, probe = lo[inner], hi[inner], blo[inner], bhi[inner], probe[inner]
        n = hi - lo - 1  # ends that could be cuts: lo .. hi - 2
        middle = n // 2
        side = np.where(probe & 1, -(probe + 1) // 2, probe // 2)  # 0, -1, 1, -2, 2, ... reaches all n places
        at = lo + middle + side
        other = np.searchsorted(ends_b, ends_a[at])
        hit = ends_b[other] == ends_a[at]
        for k in np.flatnonzero(~hit & (probe + 1 >= PROBES)).tolist():  # long without a cut around the middle: all its ends
            own = ends_a[lo[k]:hi[k] - 1]
            found = np.searchsorted(ends_b, own)
            same = np.flatnonzero(ends_b[found] == own)
            probe[k] = n[k]
            if len(same):
                nearest = same[np.abs(same - middle[k]).argmin()]
                at[k], other[k], hit[k] = lo[k] + nearest, found[nearest], True
        probe = probe + 1
        done_a.append(at[hit])
        done_b.append(other[hit])
        miss, zero = ~hit, np.zeros(int(hit.sum()), np.int64)
        lo, hi, blo, bhi, probe = (np.concatenate(x) for x in (
            (lo[miss], lo[hit], at[hit] + 1), (hi[miss], at[hit] + 1, hi[hit]), (blo[miss], blo[hit], other[hit] + 1),
            (bhi[miss], other[hit] + 1, bhi[hit]), (probe[miss], zero, zero)))
    return np.sort(np.concatenate(done_a)), np.sort(np.concatenate(done_b))


class Alignment:
    """The groups of some texts. Text i has groups first[i] to first[i + 1]; group g ends with tokens cut_a[g] and cut_b[g]."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str]):
        a, b = tokenizers.encode(texts)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        self.ids_a, self.ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, self.n_a), (b, self.n_b)))
        self.first_a, self.first_b = (np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        self.cut_a, self.cut_b = shared_cuts(np.cumsum(tokenizers.size_a[self.ids_a]), np.cumsum(tokenizers.size_b[self.ids_b]), self.first_a, self.first_b)
        self.size_a, self.size_b = (np.diff(x, prepend=-1) for x in (self.cut_a, self.cut_b))
        self.first = np.searchsorted(self.cut_a, self.first_a)  # a text's first group ends at or after its first token
        self.n_groups = np.diff(self.first)

    def text_of_group(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_groups)), self.n_groups)

    def written(self, tables: list[str], split: int) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each text. Tables: an id and what follows it, inside a group and at its end; those of b from ``split``."""
        group_a, group_b = (np.repeat(np.arange(len(x)), x) for x in (self.size_a, self.size_b))
        line = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        code = 2 * self.ids_a
        code[self.cut_a] += 1
        line[np.arange(len(code)) + (self.cut_b - self.size_b + 1)[group_a]] = code
        code = split + 2 * self.ids_b
        code[self.cut_b] += 1
        line[np.arange(len(code)) + (self.cut_a + 1)[group_b]] = code
        parts, to = line.tolist(), (self.first_a + self.first_b).tolist()
        return ["".join([tables[c] for c in parts[x:y]])[:-1] for x, y in zip(to, to[1:])]

    def links(self, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, id a, id b, times) of all links; a pair can come more than once for a text."""
        text, n = self.text_of_group(), self.size_a * self.size_b
        some = np.flatnonzero(n <= wide)
        m = n[some]
        g = np.repeat(some, m)
        k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        q = self.size_b[g]
        a = (self.cut_a - self.size_a + 1)[g] + k // q
        b = (self.cut_b - self.size_b + 1)[g] + k % q
        out = [(text[g], self.ids_a[a], self.ids_b[b], np.ones(len(g), np.int64))]
        for g in np.flatnonzero(n > wide).tolist():
            (ua, na), (ub, nb) = (np.unique(ids[cut[g] - size[g] + 1:cut[g] + 1], return_counts=True)
                                  for ids, cut, size in ((self.ids_a, self.cut_a, self.size_a), (self.ids_b, self.cut_b, self.size_b)))
            out.append((np.full(len(ua) * len(ub), text[g]), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(na, nb).ravel()))
        return tuple(np.concatenate(x) for x in zip(*out))


def _written_tables(t: Tokenizers) -> tuple[list[str], int]:
    a = [f"{i}{end}" for i in range(len(t.bytes_a)) for end in ",|"]
    return a + [f"{i}{end}" for i in range(len(t.bytes_b)) for end in ",;"], len(a)


def _texts(c) -> list[str]:
    raw, o = c.data.tobytes(), c.offsets.tolist()
    return [raw[a:b].decode() for a, b in zip(o, o[1:])]


def align(docs: DataFrame, byte_json: str, piece_model: str, text: str = "text", name: str = "groups", byte_ranks: str | None = None) -> DataFrame:
    """docs with an array of groups, each with the ids of both tokenizers in it.

    A null or empty text has none, nor has one whose tokens of either do not spell a
    space and the text. Every row is returned; a column of that name is replaced.
    """
    def maker():
        tokenizers = Tokenizers(byte_json, piece_model, byte_ranks)

        def run(chunk):
            x = Alignment(tokenizers, _texts(chunk))
            ids = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], cut + 1)), pa.int32()), pa.array(ids, pa.int32()))
                   for cut, ids in ((x.cut_a, x.ids_a), (x.cut_b, x.ids_b))]
            return [pa.ListArray.from_arrays(pa.array(x.first, pa.int32()), pa.StructArray.from_arrays(ids, names=["a", "b"]))]
        return run

    return with_text_columns(docs, text, f"`{name}` array<struct<a: array<int>, b: array<int>>>", maker)


_COUNTS = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string")]


def _listed(byte_json: str, piece_model: str, byte_ranks: str | None, block: int):
    """Rows of documents (block, their counts, places and times of their pairs) and of blocks (block, pairs, documents of each)."""
    def run(batches):
        from pyspark import TaskContext
        t = Tokenizers(byte_json, piece_model, byte_ranks)
        tables, split = _written_tables(t)
        base, n_pairs = len(t.bytes_b), len(t.bytes_a) * len(t.bytes_b)
        number = TaskContext.get().partitionId() << 40
        ids: list[pa.Array] = []
        counts: list[list] = []
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        have = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, have
            key, n = np.concatenate(keys), np.concatenate(times)
            pairs, place, held = np.unique(key % n_pairs, return_inverse=True, return_counts=True)
            cuts = np.searchsorted(key, np.arange(len(counts) + 1) * n_pairs)
            columns = [pa.array([r[k] for r in counts], pa.string() if kind == "string" else pa.int64()) for k, (_, kind) in enumerate(_COUNTS)]
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, kind)) for x, kind in ((place, pa.int32()), (n, pa.int32()))]
            doc = pa.concat_arrays(ids)
            none = pa.nulls(len(counts), pa.list_(pa.int64()))
            names = ["doc_id", "block", *[c for c, _ in _COUNTS], "place", "times", "pairs", "held"]
            yield pa.RecordBatch.from_arrays([doc, pa.array([number] * len(counts), pa.int64()), *columns, *lists, none, none], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, doc.type), pa.array([number], pa.int64()), *[pa.nulls(1, c.type) for c in (*columns, *lists)],
                 *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, held)]], names=names)
            for x in (ids, counts, keys, times):
                x.clear()
            number, have = number + 1, 0

        for batch in batches:
            for c in text_chunks(batch.column(1), TEXT):
                x = Alignment(t, _texts(c))
                text, a, b, n = x.links()
                key, back = np.unique(((text + len(counts)) * len(t.bytes_a) + a) * base + b, return_inverse=True)
                keys.append(key)
                times.append(np.bincount(back, weights=n, minlength=len(key)).astype(np.int64))
                n_links = np.bincount(text, weights=n, minlength=len(c)).astype(np.int64)
                written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in x.written(tables, split)]
                ids.append(batch.column(0).slice(c.start, len(c)))
                counts.extend(zip(x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), n_links.tolist(), written))
                have += len(c.data)
                if have >= block:
                    yield from flush()
        if counts:
            yield from flush()
    return run


def _summed(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """Rows of one block's documents with what their links add up to."""
    order = np.argsort(sums.column("place").to_numpy(), kind="stable")
    n, best = sums.column("n").to_numpy()[order], sums.column("best").to_numpy()[order].astype(bool)
    lists = docs.column("place").combine_chunks()
    place, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists, docs.column("times").combine_chunks()))
    cuts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    n_best, total = (np.concatenate(([0], np.cumsum(x))) for x in (times * best[place], times * n[place]))
    return docs.drop_columns(["block", "place", "times"]).append_column("n_best", pa.array(np.diff(n_best[cuts]), pa.int64())).append_column(
        "count_sum", pa.array(np.diff(total[cuts]), pa.int64()))


def linked(docs: DataFrame, byte_json: str, piece_model: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK,
           byte_ranks: str | None = None) -> DataFrame:
    """A row for each document: tokens of both, groups, links, and how common its links are.

    A link is a pair of token occurrences in one group. The count of an id pair is the
    number of documents (rows) that hold it linked. n_best counts the links whose count is
    the highest of their first id, ties included; count_sum adds the counts of all links.
    Documents without tokens (see ``align``) have zeros and an empty groups_sha256.
    Rows of one doc_id are documents of their own, a null doc_id stays null, and no rows
    give no rows. ``block`` changes cost, not results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "links")
    small_batches(spark)
    src = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = src.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)]).add("block", "long")
    for name, t in _COUNTS:
        schema = schema.add(name, t)
    for name, t in (("place", "int"), ("times", "int"), ("pairs", "long"), ("held", "long")):
        schema = schema.add(name, T.ArrayType({"int": T.IntegerType(), "long": T.LongType()}[t]))
    listed = scratch.keep(src.mapInArrow(_listed(byte_json, piece_model, byte_ranks, block), schema))

    pairs = listed.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select(
        "block", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    size_b = Tokenizers(byte_json, piece_model).b.get_piece_size()
    counted = pairs.groupBy("pair").agg(F.sum("held").alias("n"))
    of_a = Window.partitionBy(F.expr(f"pair div {size_b}"))  # at most as many rows as the other tokenizer has ids
    counted = scratch.keep(counted.withColumn("best", F.col("n") == F.max("n").over(of_a)))
    sums = pairs.select("block", "place", "pair").join(counted, "pair").select(F.col("block").alias("of"), "place", "n", "best")
    rows = listed.where("pairs is null").drop("pairs", "held")
    out = T.StructType([f for f in rows.schema if f.name not in ("block", "place", "times")]).add("n_best", "long").add("count_sum", "long")
    return rows.groupBy("block").cogroup(sums.groupBy("of")).applyInArrow(_summed, out)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = linked(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
                 byte_ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
