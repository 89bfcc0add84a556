"""Removal of byte strings that repeat across documents, by the suffix order of a collection.

A byte goes if a 50-byte string covers it that also starts in a document of smaller id.

0. A text that a document of smaller id holds as a whole goes altogether; only the
   first document of each text takes part in what follows.
1. The least hash among the 16-byte grams of a 50-byte window is its seed. Equal
   windows have equal seeds. Tasks count in how many documents a seed occurs, as
   sorted packed arrays by hash range; a bit map of at most 64 MB marks the seeds that
   more than one document holds. It is only a filter: the fewer bits a seed gets at
   scale, the more fragments travel, with the same result.
2. The neighbouring windows of one seed form a fragment of at most 84 bytes. Fragments
   of marked seeds are partitioned by seed, so equal windows meet in one task; equal
   fragments of a task travel as one row with all their places.
3. There, distinct fragments form a collection; its Burrows-Wheeler transform and
   common prefixes are built column by column (``bwt``), and neighbouring suffixes that
   share 50 bytes are one class of equal windows. Each class has a first document.
4. Removed ranges are gathered by document and cut out of its bytes.

A seed in more documents than ``HOT`` (or a four-millionth of all seeds) would make a
large group in one task. Its windows travel singly instead, as 128-bit hashes: the
first document of each is a partial minimum, joined back in a join that adaptive
execution can split. The list of such seeds holds four million at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import words
from .bwt import window_classes
from .common import Chunk, Scratch, col, read, small_batches, text_chunks

WIDTH, GRAM, BLOCK = 50, 16, 5
SPAN = WIDTH - GRAM + 1  # grams in a window, and the most windows to a fragment
SEEDS_AT_ONCE = 1 << 20  # seeds a task packs together
BUCKET_SEEDS = 1 << 20  # seeds to a hash range, about
MAX_FILTER_BITS = 29
HOT, MAX_HOT = 50_000, 4_000_000
MAX_COPIES = 1_000_000  # whole copies whose ids are broadcast, 16 MB; beyond that they are joined by shuffle
COLLECTION = 65_000  # bytes to a collection, unless one seed has more
ROWS = 4_000  # rows of pieces handled together in a task
PENDING = 100_000  # fragments a task gathers to send equal pieces once
WHO = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i4")])

_BYTES = words.mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray, k: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of k bytes, by doubling."""
    p = np.full(1, multiplier, np.uint64)
    h, out, done, have, left, n = _BYTES[data], None, 0, 1, k, len(data) - k + 1
    while left:
        if left & 1:
            out = h[done:done + n] if out is None else out * p + h[done:done + n]
            done += have
        left >>= 1
        if left:
            h = h[:-have] * p + h[have:]
            p, have = p * p, have * 2
    return words.mix(out)


class Fragments:
    """seed, text (row of the chunk), start and number of windows of every fragment of a chunk."""

    def __init__(self, chunk: Chunk):
        n = len(chunk.data) - WIDTH + 1
        if n <= 0:
            self.seed = np.zeros(0, np.uint64)
            self.text = self.start = self.windows = np.zeros(0, np.int64)
            return
        least = gram_hashes(chunk.data, GRAM)
        have = 1
        while have * 2 <= SPAN:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < SPAN:
            least = np.minimum(least[:n], least[SPAN - have:SPAN - have + n])
        size = np.diff(chunk.offsets)
        valid = np.zeros(n + 1, np.int32)  # windows within one text
        whole = np.flatnonzero(size >= WIDTH)
        valid[chunk.offsets[whole]] += 1
        valid[np.minimum(chunk.offsets[whole + 1] - WIDTH + 1, n)] -= 1
        valid = np.cumsum(valid[:n]) > 0
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        new[chunk.offsets[whole]] = True
        edge = np.flatnonzero(new | ~valid)
        run = np.diff(np.append(edge, n))
        keep = valid[edge]
        edge, run = edge[keep], run[keep]
        parts = -(-run // SPAN)  # a long run of one seed is cut
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(edge, parts) + nth * SPAN
        self.windows = np.minimum(np.repeat(run, parts) - nth * SPAN, SPAN)
        self.seed = words.mix(least[self.start])  # least values crowd at the low end; spread them again
        self.text = np.searchsorted(chunk.offsets, self.start, "right") - 1


def _pack(buckets: int):
    """Tasks' seeds as rows (bucket, keys, texts): 32 bits of hash and the number of texts of each."""
    def run(batches):
        seeds, texts, have, at = [], [], 0, 0

        def flush():
            seed, text = np.concatenate(seeds), np.concatenate(texts)
            order = np.lexsort((text, seed))
            seed, text = seed[order], text[order]
            once = np.ones(len(seed), bool)
            once[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
            seed = seed[once]
            key = seed >> np.uint64(32 - buckets)
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(head)
            count = np.diff(np.append(first, len(key))).astype("<u4")
            key = key[first]
            cut = np.searchsorted(key >> np.uint64(32), np.arange((1 << buckets) + 1).astype(np.uint64))
            low = key.astype("<u4")
            full = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([low[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary()),
                 pa.array([count[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary())], names=["bucket", "keys", "texts"])

        for batch in batches:
            for c in text_chunks(batch.column(0)):
                f = Fragments(c)
                seeds.append(f.seed)
                texts.append(f.text + at)
                have += len(f.seed)
                at += len(c)
                if have >= SEEDS_AT_ONCE:
                    yield flush()
                    seeds, texts, have = [], [], 0
        if have:
            yield flush()
    return run


def _mark(bits: int, hot: int):
    """A bucket's part of the bit map, and its seeds of more than ``hot`` texts."""
    def run(rows: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("keys").to_pylist()])
        texts = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("texts").to_pylist()])
        order = np.argsort(key, kind="stable")
        key, texts = key[order], texts[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(texts, first)
        flags = np.zeros(1 << bits, np.uint8)
        flags[key[first[total > 1]] >> np.uint32(32 - bits)] = 1
        return pa.table({"bucket": rows.column("bucket").slice(0, 1).cast(pa.int32()), "map": pa.array([np.packbits(flags).tobytes()], pa.binary()),
                         "hot": pa.array([key[first[total > hot]].astype(np.int64)], pa.list_(pa.int64()))})
    return run


class Filter:
    """Seeds that more than one document may hold, and those that very many hold."""

    def __init__(self, bits: int, buckets: int, flags: np.ndarray, hot: np.ndarray):
        self.bits, self.buckets, self.flags, self.hot = bits, buckets, flags, hot

    def shared(self, seed: np.ndarray) -> np.ndarray:
        at = seed >> np.uint64(64 - self.bits)
        return (self.flags[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1

    def is_hot(self, seed: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(seed), bool)
        key = seed >> np.uint64(32 - self.buckets)
        return self.hot[np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)] == key


def _filter(texts: DataFrame, size: int, hot: int) -> Filter:
    seeds = max(size * 2 // (SPAN + 1), 1)  # expected number for that many bytes
    buckets = min(max((seeds // BUCKET_SEEDS).bit_length(), 4), 24)
    bits = min(max(seeds.bit_length() + 2, buckets + 3, 16), MAX_FILTER_BITS)
    hot = max(hot, seeds // MAX_HOT)
    rows = (texts.mapInArrow(_pack(buckets), "bucket int, keys binary, texts binary")
            .groupBy("bucket").applyInArrow(_mark(bits - buckets, hot), "bucket int, map binary, hot array<bigint>")
            .collect())  # 2^bits / 8 bytes, 64 MB at most, and MAX_HOT numbers
    flags = np.zeros(1 << (bits - 3), np.uint8)
    part = 1 << (bits - buckets - 3)
    for r in rows:
        flags[r.bucket * part:(r.bucket + 1) * part] = np.frombuffer(r.map, np.uint8)
    keys = np.array(sorted((r.bucket << 32) | k for r in rows for k in r.hot), np.uint64)
    return Filter(bits, buckets, flags, keys)


def _emit(shared):
    """Rows (seed, piece, who) of the marked fragments.

    A task sends a piece once for every PENDING fragments, with all its places (WHO).
    """
    def run(batches):
        marks = shared.value
        number: dict[tuple[int, bytes], int] = {}
        which: list[int] = []
        who: list[np.ndarray] = []

        def flush():
            order = np.argsort(np.array(which), kind="stable")
            places = np.concatenate(who)[order].tobytes()
            to = np.cumsum(np.bincount(which)) * WHO.itemsize
            out = pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in number], pa.int64()), pa.array([p for _, p in number], pa.binary()),
                 pa.array([places[a:b] for a, b in zip([0, *to], to)], pa.binary())], names=["seed", "piece", "who"])
            number.clear()
            which.clear()
            who.clear()
            return out

        for batch in batches:
            docs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in text_chunks(batch.column(2)):
                f = Fragments(c)
                keep = np.flatnonzero(marks.shared(f.seed))
                keep = keep[~marks.is_hot(f.seed[keep])]
                if not len(keep):
                    continue
                start, size, text = f.start[keep], f.windows[keep] + WIDTH - 1, f.text[keep]
                raw = c.data.tobytes()
                which += [number.setdefault((s, raw[a:b]), len(number)) for s, a, b in
                          zip(f.seed[keep].view(np.int64).tolist(), start.tolist(), (start + size).tolist())]
                place = np.empty(len(keep), WHO)
                place["doc"], place["row"], place["start"] = docs[c.start + text], rows[c.start + text], start - c.offsets[text]
                who.append(place)
                if len(which) >= PENDING:
                    yield flush()
        if which:
            yield flush()
    return run


def _match(batches):
    """Removed ranges from fragments that arrive in order of their seed."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        held.append(batch)
        have += batch.num_rows
        if have >= ROWS:
            table = pa.Table.from_batches(held)
            seed = table.column("seed").to_numpy()
            cut = int(np.searchsorted(seed, seed[-1]))  # the last seed may go on
            if cut:
                yield from _ranges(table.slice(0, cut))
                held, have = table.slice(cut).to_batches(), table.num_rows - cut
            else:
                held = table.to_batches()
    if have:
        yield from _ranges(pa.Table.from_batches(held))


def _ranges(table: pa.Table):
    seed = table.column("seed").to_numpy()
    first = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(seed))))
    lists = table.column("who").to_pylist()
    places = np.frombuffer(b"".join(lists), WHO)
    length = np.array([len(x) for x in lists]) // WHO.itemsize
    at = np.cumsum(length) - length  # first place of each row
    low, high = np.minimum.reduceat(places["doc"], at), np.maximum.reduceat(places["doc"], at)
    several = np.minimum.reduceat(low, first) < np.maximum.reduceat(high, first)
    rows = np.flatnonzero(several[group])
    if not len(rows):
        return
    pieces = table.column("piece").take(pa.array(rows)).to_pylist()
    number: dict[tuple[int, bytes], int] = {}
    which = np.array([number.setdefault(x, len(number)) for x in zip(group[rows].tolist(), pieces)])
    length = length[rows]
    which = np.repeat(which, length)
    places = places[np.repeat(at[rows] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
    doc = places["doc"]
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    pieces = [p for _, p in number]
    owner = np.array([g for g, _ in number])
    size = np.array([len(p) for p in pieces])
    ends = np.cumsum(size)
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    classes, count = [], size - WIDTH + 1
    total, at = 0, 0
    bounds = np.append(heads, len(pieces))
    while at < len(heads):  # whole seeds, about COLLECTION bytes together
        a = bounds[at]
        done = ends[a] - size[a]
        stop = max(int(np.searchsorted(ends[bounds[1:] - 1], done + COLLECTION, "right")), at + 1)
        b = bounds[stop]
        offsets = np.concatenate(([0], np.cumsum(size[a:b])))
        own, _ = window_classes(np.frombuffer(b"".join(pieces[a:b]), np.uint8), offsets, WIDTH, BLOCK)
        classes.append(own + total)
        total += int(own.max()) + 1
        at = stop
    classes = np.concatenate(classes)
    earliest = np.full(total, np.iinfo(np.int64).max)
    np.minimum.at(earliest, classes, np.repeat(least, count))
    earliest = earliest[classes]  # first document of each window of each piece
    begin = np.cumsum(count) - count
    many = count[which]
    to = np.cumsum(many) - many
    place = np.arange(int(many.sum())) - np.repeat(to, many)
    gone = earliest[np.repeat(begin[which], many) + place] < np.repeat(doc, many)
    edge = np.zeros(len(gone) + 1, bool)
    edge[to] = True
    edge[-1] = True
    before = np.append(False, gone[:-1]) & ~edge[:-1]
    after = np.append(gone[1:], False) & ~edge[1:]
    opens, closes = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    if not len(opens):
        return
    row = np.searchsorted(to, opens, "right") - 1
    start = places["start"][row].astype(np.int64)
    span = ((start + place[opens]) << 32) | (start + place[closes] + WIDTH)
    yield pa.RecordBatch.from_arrays([pa.array(doc[row].astype(np.int64)), pa.array(places["row"][row].astype(np.int64)), pa.array(span)],
                                     names=["doc", "row", "span"])


def _hot_windows(shared):
    """Rows (h1, h2, doc, row, start) of every window with a hot seed."""
    def run(batches):
        marks = shared.value
        for batch in batches:
            for c in text_chunks(batch.column(2)):
                f = Fragments(c)
                keep = np.flatnonzero(marks.is_hot(f.seed))
                if not len(keep):
                    continue
                many = f.windows[keep]
                at = np.repeat(f.start[keep], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                text = np.repeat(f.text[keep], many)
                rows = pa.array(c.start + text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram_hashes(c.data, WIDTH)[at].view(np.int64)),
                     pa.array(gram_hashes(c.data, WIDTH, 0xD6E8FEB86659FD93)[at].view(np.int64)),
                     batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - c.offsets[text])],
                    names=["h1", "h2", "doc", "row", "start"])
    return run


def repeated_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, row, span) of removed ranges, overlapping ones included; span is start << 32 | end.

    ``docs`` has columns doc, row (tells rows of one doc apart) and text, none of them null.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = spark.sparkContext.broadcast(_filter(docs.select("text"), size, hot))
    pieces = docs.select("doc", "row", "text").mapInArrow(_emit(shared), "seed long, piece binary, who binary")
    found = (pieces.repartition("seed").sortWithinPartitions("seed")
             .mapInArrow(_match, "doc long, row long, span long"))
    if len(shared.value.hot):
        w = docs.select("doc", "row", "text").mapInArrow(_hot_windows(shared), "h1 long, h2 long, doc long, row long, start long")
        least = w.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
        late = w.join(least, ["h1", "h2"]).where("least < doc")
        found = found.unionAll(late.select("doc", "row", F.shiftleft("start", 32).bitwiseOR(F.col("start") + WIDTH).alias("span")))
    return found


def _copies(rows: DataFrame) -> DataFrame:
    """(doc, row, size) of texts that a document of smaller id holds as a whole, of WIDTH bytes or more.

    Only hashes, ids and sizes are shuffled; the first document of a text is a partial minimum.
    """
    keys = rows.where(F.octet_length("text") >= WIDTH).select(
        "doc", "row", F.unhex(F.md5("text")).alias("h"), F.octet_length("text").cast("long").alias("size"))
    first = keys.groupBy("h").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(first, "h").where("doc > first").select("doc", "row", "size")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT,
                   max_broadcast: int = MAX_COPIES) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges: start, end), kept (remaining bytes).

    A null text counts as empty; a text of fewer than 50 bytes keeps all. Rows with a
    null doc_id are neither sources nor cut. Rows of one doc_id are the same document:
    none is earlier than the other. One row for each row of docs; other columns are
    ignored. ``hot`` and ``max_broadcast`` change how frequent seeds and copies are
    handled, not the result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    ids = rows.where("doc_id is not null").groupBy("doc_id").count()
    unique = ids.where("count > 1").limit(1).count() == 0
    tell = F.lit(0).cast("long") if unique else F.xxhash64("text")
    rows = rows.select("doc_id", "text", tell.alias("row"))
    source = rows.select(F.col("doc_id").cast("long").alias("doc"), "row", "text").where("doc is not null and text is not null")
    copies = Scratch(docs.sparkSession, "repeats").keep(_copies(source))
    # Whole copies of earlier texts go altogether and add no string that is not there already.
    ids = copies.select("doc", "row")
    ids = F.broadcast(ids) if copies.count() <= max_broadcast else ids  # 16 bytes each; more of them are joined by shuffle
    found = repeated_ranges(source.join(ids, ["doc", "row"], "left_anti"), hot)
    found = found.unionAll(copies.select("doc", "row", F.col("size").alias("span")))
    spans = found.groupBy("doc", "row").agg(F.collect_list("span").alias("found"))  # of one document
    joined = rows.join(spans.withColumnRenamed("row", "r"), (F.col("doc_id").cast("long") == F.col("doc")) & (F.col("row") == F.col("r")), "left")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(
        "n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary").fields])
    return joined.select("doc_id", "text", "found").mapInArrow(_cut, schema)


def _cut(batches):
    for batch in batches:
        for c in text_chunks(batch.column(1)):
            own = batch.column(2).slice(c.start, len(c))
            count = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
            span = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(len(c)), count)
            cover = np.zeros(len(c.data) + 1, np.int32)
            np.add.at(cover, c.offsets[text] + (span >> 32), 1)
            np.add.at(cover, c.offsets[text] + (span & 0xFFFFFFFF), -1)
            gone = np.cumsum(cover[:-1]) > 0
            head = np.zeros(len(gone) + 1, bool)
            head[c.offsets] = True  # ranges end where a text ends
            start = np.flatnonzero(gone & (~np.append(False, gone[:-1]) | head[:-1]))
            end = np.flatnonzero(gone & (~np.append(gone[1:], False) | head[1:])) + 1
            of = np.searchsorted(c.offsets, start, "right") - 1
            base = c.offsets[of]
            at = np.searchsorted(start, c.offsets)
            kept = c.data[~gone].tobytes()
            stay = np.concatenate(([0], np.cumsum(~gone)))[c.offsets].tolist()
            spans = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.start, len(c)), pa.array(np.diff(c.offsets)),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans),
                 pa.array([kept[a:b] for a, b in zip(stay, stay[1:])], pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))
