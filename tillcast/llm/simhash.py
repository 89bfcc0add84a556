"""SimHash near-duplicates, candidates by the pigeonring principle.

Texts become 64-bit fingerprints; equal fingerprints collapse before any join. A
fingerprint is a ring of ``m`` segments. If two differ in at most ``t`` bits, then
from some segment on every chain of l consecutive segments differs in at most
l*t/m bits. The chain's first segments therefore agree exactly, and are the join
key; the longer chains are tested on the pairs that meet, then the whole distance.

A bucket of more than ``BUCKET`` distinct fingerprints is not paired. Its members
are linked exactly another way: two fingerprints within two bits of each other have
a common neighbour within one bit, so each is listed under itself and its 64 one-bit
neighbours, and all under one entry are linked to the smallest of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillcast.operators.components import connected_components

from .common import Chunk, Scratch, col, fresh, read, with_text_columns

BITS, DISTANCE, SHINGLE, SEED = 64, 2, 3, 42
BUCKET = 64
MAX_GONE = 1_000_000  # ids to take out that are broadcast, 8 MB; beyond that they are joined by shuffle
BLOCK = 1 << 16  # shingles hashed at once


def _bit_counts(words: list[bytes], n: int) -> tuple[np.ndarray, int]:
    """How often each bit is set over the shingles' hashes, and the number of shingles."""
    from xxhash import xxh64_digest
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) < n:
        first, last = [0], [len(line)]
    else:
        first, last = starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(first), BLOCK):
        raw = b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(first[at:at + BLOCK], last[at:at + BLOCK])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts, len(first)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """docs with ``fp`` (long, called by ``name``): bit set if set in over half the shingles' XXH64.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer words
    than a shingle is one shingle; a null text or one without words has fingerprint 0.
    """
    def maker():
        def run(chunk: Chunk):
            raw, o = chunk.data.tobytes(), chunk.offsets.tolist()
            bits = np.zeros((len(chunk), BITS), bool)
            for i, (a, b) in enumerate(zip(o, o[1:])):
                words = raw[a:b].lower().split()
                if words:
                    counts, n = _bit_counts(words, shingle)
                    bits[i] = 2 * counts > n
            return [pa.array(np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64))]
        return run

    return with_text_columns(docs, text, f"`{name}` long", maker)


def _turned(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def links(distinct: DataFrame, segments: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``distance`` bits of one another.

    ``distinct`` has one row a fingerprint, in column fp. Small buckets give every
    linked pair; large ones stars with the same components.
    """
    width = BITS // segments
    agree = next(k for k in range(segments, 0, -1) if k * distance < segments)  # first segments without a difference
    prefix = agree * width
    scratch = Scratch(distinct.sparkSession, "simhash")
    keyed = distinct.select("fp", F.posexplode(F.array(
        *[F.shiftrightunsigned(_turned(F.col("fp"), i * width), BITS - prefix) for i in range(segments)])).alias("i", "key"))
    sizes = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = scratch.keep(keyed.join(sizes, ["i", "key"]))
    few = met.where(F.col("c") <= BUCKET)
    pairs = (few.select("i", "key", F.col("fp").alias("a")).join(few.select("i", "key", F.col("fp").alias("b")), ["i", "key"])
             .where("a < b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for i in range(segments):
        turned, ok = _turned(diff, i * width), F.col("i") == i
        for k in range(agree + 1, segments + 1):
            ok &= F.bit_count(F.shiftrightunsigned(turned, BITS - k * width)) <= k * distance // segments
        chain |= ok
    near = pairs.where(chain).select("a", "b").distinct()
    many = met.where(F.col("c") > BUCKET).select("fp").distinct()
    around = many.select("fp", F.explode(F.array(F.col("fp"), *[
        F.col("fp").bitwiseXOR(F.lit(1 << j if j < 63 else -(1 << 63))) for j in range(BITS)])).alias("w"))
    star = (around.groupBy("w").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
            .select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct())
    return near.unionAll(star)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row a row.

    Fingerprints within two bits are linked, and so are all texts of a fingerprint, the
    empty one included. ``segments`` changes cost, not results. An empty table gives an
    empty result; rows with a null doc_id are fingerprinted and join a component, whose
    id is the smallest id that is not null.
    """
    found = _members(docs, doc_id, text, segments)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(docs: DataFrame, doc_id: str, text: str, segments: int | None = None) -> DataFrame:
    """(doc_id, fp, component, component_id), one row a row; component is the smallest fingerprint reachable."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = fingerprints(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")))
    prints = scratch.keep(prints.select("doc_id", "fp"))
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    if segments is None:
        segments = 8 if distinct.count() < 1 << 26 else 16  # keys of 24 or 28 bits
    roots = connected_components(links(distinct.select("fp"), segments))
    placed = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    placed = scratch.keep(placed)
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    table = placed.join(names, "component").select("fp", "component", "component_id")
    return prints.join(table, "fp").select("doc_id", "fp", "component", "component_id")


def keep_first(docs: DataFrame, found: DataFrame, node: str, doc_id: str, text: str, max_broadcast: int = MAX_GONE) -> DataFrame:
    """Of each component the row of the smallest doc_id, once.

    docs has a column ``node`` that names a row's text; found (doc_id, node, component)
    has all its rows with an id. Decided by row, so another text under the same id
    stays if its own component has no smaller id. Of equal nodes under one id the least
    text stays.
    """
    scratch = Scratch(docs.sparkSession, "first")
    rows = scratch.keep(found.groupBy("component", "doc_id", "node").agg(F.count(F.lit(1)).alias("n")))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    rows = rows.join(first, "component").withColumn("stays", F.struct("doc_id", "node") == F.col("first"))
    rows = scratch.keep(rows.where("not stays or n > 1").select(F.col("doc_id").alias("__i"), F.col("node").alias("__n"), "stays"))

    def named(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= max_broadcast else df  # some bytes each; more are joined by shuffle

    same = (col(doc_id) == F.col("__i")) & (col(node) == F.col("__n"))
    gone, twice = (named(rows.where(c).select("__i", "__n")) for c in (~F.col("stays"), F.col("stays")))
    out = docs.join(gone, same, "left_anti")
    if rows.where("stays").limit(1).count() == 0:
        return out
    every = F.struct(*map(col, docs.columns))
    once = (out.join(twice, same, "left_semi").groupBy(col(doc_id), col(node))
            .agg(F.min_by(every, F.struct(col(text), F.xxhash64(every))).alias("__row")))
    return out.join(twice, same, "left_anti").unionByName(once.select("__row.*"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_GONE) -> DataFrame:
    """Of each component the row of the smallest doc_id, once; columns are those of docs.

    Rows without a doc_id cannot be told apart and all stay. ``max_broadcast`` changes
    how rows are taken out, not which.
    """
    name = fresh(docs, "__fp")
    found = _members(docs.where(col(doc_id).isNotNull()), doc_id, text).withColumnRenamed("fp", "node")
    return keep_first(fingerprints(docs, text, name=name), found, name, doc_id, text, max_broadcast).select(*map(col, docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
