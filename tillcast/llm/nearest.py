"""Nearest vectors by cosine, as a block matrix join with int8 tiles.

Queries and candidates are dealt to groups by a hash of the id; each pair of a query
group and a candidate group is a cell, joined by its number. In a cell, unit vectors
are rounded to int8; the product of a query block and a candidate tile gives every
cosine up to a known error, the rounding errors' lengths being known for each vector.
Only candidates whose upper bound reaches the k-th best lower bound are computed again
in double precision on the original vectors, and merged into each query's k best with
a heap. No candidate that could be among the k nearest is left out: the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import col, read

QUERY_GROUP, CANDIDATE_GROUP, TILE = 1024, 1 << 16, 4096
EXACT_PAIRS = 1 << 15  # pairs recomputed at once


class Block:
    """Vectors with their int8 codes and error bounds."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.length = np.sqrt((v * v).sum(axis=1))
        unit = v / self.length[:, None]
        step = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / step[:, None]).astype(np.int8)
        near = codes * step[:, None]
        self.step, self.codes = step, codes
        self.error = np.sqrt(((unit - near) ** 2).sum(axis=1)) + 1e-12
        self.reach = np.sqrt((near * near).sum(axis=1))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in lists.chunks], lists.type.value_type).to_numpy().astype(np.float64)
    v = flat.reshape(len(lists), -1)
    top = np.abs(v).max(axis=1, keepdims=True)
    odd = (top > 1e100) | (top < 1e-100)  # lengths would leave the range of doubles; a cosine has no scale
    return np.where(odd, v / top, v) if odd.any() else v


def _cell(k: int):
    def join(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        best: list[list[tuple[float, int]]] = [[] for _ in range(queries.num_rows)]
        if candidates.num_rows and queries.num_rows:
            q = Block(queries.column("id").to_numpy(), _matrix(queries.column("v")))
            exact_in = np.float32 if q.v.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products stay whole numbers
            codes = q.codes.astype(exact_in)
            order = np.argsort(candidates.column("id").to_numpy(), kind="stable")
            for at in range(0, len(order), TILE):
                part = candidates.take(order[at:at + TILE])
                _tile(q, codes, Block(part.column("id").to_numpy(), _matrix(part.column("v"))), best, k)
        rows = [(i, c, -s) for i, b in zip(queries.column("id").to_pylist(), best) for s, c in b]
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()),
                         "vec_id": pa.array([r[1] for r in rows], pa.int64()),
                         "score": pa.array([r[2] for r in rows], pa.float64())})
    return join


def _tile(q: Block, codes: np.ndarray, c: Block, best: list, k: int) -> None:
    """Merge a tile's candidates into the k best (-score, id) of each query."""
    near = (codes @ c.codes.astype(codes.dtype).T).astype(np.float64)
    near *= q.step[:, None]
    near *= c.step[None, :]
    slack = q.error[:, None] * (c.reach + c.error)[None, :] + q.reach[:, None] * c.error[None, :]
    own = q.ids[:, None] == c.ids[None, :]
    low = near - slack
    low[own] = -np.inf
    floor = np.array([-b[-1][0] if len(b) == k else -np.inf for b in best])
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
    near += slack
    near[own] = -np.inf
    qi, ci = np.nonzero((near >= floor[:, None]) & ~own)
    score = np.empty(len(qi))
    for at in range(0, len(qi), EXACT_PAIRS):
        a, b = qi[at:at + EXACT_PAIRS], ci[at:at + EXACT_PAIRS]
        score[at:at + EXACT_PAIRS] = (q.v[a] * c.v[b]).sum(axis=1) / (q.length[a] * c.length[b])
    cuts = np.searchsorted(qi, np.arange(len(best) + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        own_rows = slice(cuts[i], cuts[i + 1])
        found = zip((-score[own_rows]).tolist(), c.ids[ci[own_rows]].tolist())
        best[i] = heapq.nsmallest(k, heapq.merge(best[i], sorted(found)))


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of ``vectors``.

    Largest cosine first, ties to the smaller vec_id; fewer rows if there are fewer
    candidates. Vectors that are null, empty, zero, or hold a null or a non-finite
    number, and rows with a null id, take no part; vectors of another dimension than
    the query's are no candidates. Rows with the query's own id are not candidates;
    a query id that repeats is answered once. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = col(embedding)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return (df.where(col(vec_id).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
                .select(col(vec_id).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")))

    c, q = clean(vectors), clean(queries).dropDuplicates(["id"])
    n, n_q = c.count(), q.count()
    cells = max(-(-n // CANDIDATE_GROUP), min(spark.sparkContext.defaultParallelism, -(-n // TILE)), 1)
    blocks = max(-(-n_q // QUERY_GROUP), 1)
    c = c.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(cells))).withColumn("q", F.explode(_numbers(blocks)))
    q = (q.withColumn("q", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(blocks)))
         .withColumn("c", F.explode(_numbers(cells))))
    found = (c.groupBy("dim", "c", "q").cogroup(q.groupBy("dim", "c", "q"))
             .applyInArrow(_cell(k), "query_id long, vec_id long, score double"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
