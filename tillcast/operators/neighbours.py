"""Exact nearest neighbours over all rows, without all pairs.

Rows go to their nearest of some pivots, and the rows of a pivot to rings by distance; a
ring is a cell with a box around its rows. For a row and a cell the triangle inequality
on pivot distances and the box give the least and the greatest distance that a row of the
cell can have. The row's k nearest in its own cell, or the cells that must hold k rows,
bound the k-th distance; only cells that could hold a nearer row are opened.

Pivots are bounded by MAX_PIVOTS and cells by MAX_CELLS, so that both can be broadcast;
beyond that cells grow. A cell of more rows than planned (equal rows) is cut into tiles,
and the rows that look into a cell are cut into chunks, so no task holds more than a tile
and a chunk.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import written

MAX_PIVOTS, MAX_CELLS = 1024, 1 << 16
STEP = 1 << 22  # numbers of a distance block


def _vectors(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, summed column by column, so that equal pairs have equal distances in every block."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j][:, None] - b[:, j][None, :]
        total += gap * gap
    return np.sqrt(total)


def k_smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of each row, ties to the smaller column."""
    if d.shape[1] > k:
        row, column = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1:k])
    else:
        row, column = (x.ravel() for x in np.indices(d.shape))
    order = np.lexsort((column, d[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _near(queries: pa.Table, rows: pa.Table, d: int, k: int, rid: str) -> pa.Table:
    """(rid, o, d): the k rows nearest to each query, itself left out. ``rows`` in order of id."""
    a, b = _vectors(queries.column("f"), d), _vectors(rows.column("f"), d)
    q_id, r_id = queries.column(rid).combine_chunks(), rows.column(rid).combine_chunks()
    where = {x: i for i, x in enumerate(r_id.to_pylist())}
    own = np.array([where.get(x, -1) for x in q_id.to_pylist()], np.int64)
    out = []
    step = max(1, STEP // max(len(b), 1))
    for lo in range(0, len(a) if len(b) else 0, step):
        dist = distances(a[lo:lo + step], b)
        mine = np.flatnonzero(own[lo:lo + step] >= 0)
        dist[mine, own[lo:lo + step][mine]] = np.inf
        row, column = k_smallest(dist, k)
        far = dist[row, column]
        some = np.isfinite(far)
        out.append((row[some] + lo, column[some], far[some]))
    row, column, far = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return pa.table({rid: q_id.take(pa.array(row)), "o": r_id.take(pa.array(column)), "d": pa.array(far)})


def bounds(x: np.ndarray, to_pivot: np.ndarray, cells: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from each vector to any row of each cell."""
    at = to_pivot[:, cells["pivot"]]
    low = np.maximum(at - cells["hi"], cells["lo"] - at)
    high = at + cells["hi"]
    under, over = np.zeros(at.shape), np.zeros(at.shape)
    for j in range(x.shape[1]):
        v = x[:, j][:, None]
        gap = np.maximum(np.maximum(cells["min"][:, j] - v, v - cells["max"][:, j]), 0)
        reach = np.maximum(np.abs(v - cells["min"][:, j]), np.abs(v - cells["max"][:, j]))
        under += gap * gap
        over += reach * reach
    return np.maximum(low, np.sqrt(under)), np.minimum(high, np.sqrt(over))


def nearest_all(df: DataFrame, rid: str, feats: list[str], k: int, cell_rows: int = 2000, chunk_rows: int = 4000) -> DataFrame:
    """(rid, _o, _d, _kdist): the k nearest rows of every row, itself left out, ties to the smaller id.

    Every row with its k rows, fewer where there are not so many. ``rid`` names each row
    once. Rows with a null feature take no part. ``cell_rows`` and ``chunk_rows`` change
    cost, not results.
    """
    spark, d = df.sparkSession, len(feats)
    whole = None
    for c in feats:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    base = written(df.where(whole).select(rid, F.array(*[F.col(c).cast("double") for c in feats]).alias("f")))
    n = base.count()
    empty = T.StructType([base.schema[rid]]).add(T.StructField("_o", base.schema[rid].dataType)).add("_d", "double").add("_kdist", "double")
    if n < 2:
        return spark.createDataFrame([], empty)
    cells_wanted = max(1, min(MAX_CELLS, n // cell_rows))
    cell_rows = max(cell_rows, math.ceil(n / MAX_CELLS))
    few = base.orderBy(F.xxhash64(rid), rid).limit(min(MAX_PIVOTS, max(1, math.isqrt(cells_wanted) * 2))).select("f").collect()
    pivots = spark.sparkContext.broadcast(np.unique(np.array([r.f for r in few], float), axis=0))

    def assign(batches):
        for batch in batches:
            x = _vectors(batch.column("f"), d)
            near = [distances(x[lo:lo + 1024], pivots.value) for lo in range(0, len(x), 1024)]
            pivot = np.concatenate([m.argmin(axis=1) for m in near]) if near else np.zeros(0, np.int64)
            far = np.concatenate([m.min(axis=1) for m in near]) if near else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(far)], names=[*batch.schema.names, "pivot", "far"])

    placed = written(base.mapInArrow(assign, T.StructType([*base.schema.fields]).add("pivot", "integer").add("far", "double")))
    many = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")).collect()  # a row a pivot
    cuts = {}
    for r in many:
        cuts.setdefault(max(1, math.ceil(r.c / cell_rows)), []).append(r.pivot)
    edges = None
    for rings, of in cuts.items():  # rings of about equal size from a sketch, as many as the pivot's rows need
        got = placed.where(F.col("pivot").isin(of)).groupBy("pivot").agg(
            F.percentile_approx("far", [i / rings for i in range(1, rings)] or [1.0], 2000).alias("edges") if rings > 1
            else F.array().cast("array<double>").alias("edges"))
        edges = got if edges is None else edges.unionByName(got)
    ring = F.size(F.filter("edges", lambda e: e < F.col("far")))
    ringed = placed.join(edges, "pivot").withColumn("ring", ring).drop("edges")
    tiles = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / (2 * cell_rows)).cast("int").alias("tiles"))
    cell = F.concat_ws(".", "pivot", "ring", F.pmod(F.xxhash64(rid), F.col("tiles")))
    rows = written(ringed.join(F.broadcast(tiles) if len(many) <= MAX_PIVOTS else tiles, ["pivot", "ring"]).withColumn("cell", cell).select(rid, "f", "pivot", "far", "cell"))
    sides = [e for j in range(d) for e in (F.min(F.col("f")[j]).alias(f"min{j}"), F.max(F.col("f")[j]).alias(f"max{j}"))]
    table = rows.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.count(F.lit(1)).alias("c"), F.min("far").alias("lo"), F.max("far").alias("hi"), *sides)
    table = sorted(table.collect(), key=lambda r: r.cell)  # MAX_CELLS rows and the tiles of crowded ones
    names = [r.cell for r in table]
    cells = spark.sparkContext.broadcast({
        "pivot": np.array([r.pivot for r in table]), "c": np.array([r.c for r in table]), "lo": np.array([r.lo for r in table]),
        "hi": np.array([r.hi for r in table]), "min": np.array([[r[f"min{j}"] for j in range(d)] for r in table]),
        "max": np.array([[r[f"max{j}"] for j in range(d)] for r in table]), "names": names})

    found = T.StructType([base.schema[rid]]).add(T.StructField("o", base.schema[rid].dataType)).add("d", "double")

    def inside(group: pa.Table) -> pa.Table:
        group = group.sort_by(rid)
        return _near(group, group, d, k, rid)

    own = written(rows.groupBy("cell").applyInArrow(inside, found))
    reach = own.groupBy(rid).agg(F.count(F.lit(1)).alias("m"), F.max("d").alias("kd"))
    asked = rows.join(reach.select(rid, F.when(F.col("m") == k, F.col("kd")).alias("kd")), rid, "left")

    def outside(batches):
        table = cells.value
        number = {c: i for i, c in enumerate(table["names"])}
        step = max(1, STEP // len(table["names"]))
        for batch in batches:
            x = _vectors(batch.column("f"), d)
            limit = batch.column("kd").to_numpy(zero_copy_only=False).astype(float)
            home = np.array([number[c] for c in batch.column("cell").to_pylist()], np.int64)
            for lo in range(0, len(x), step):
                part = slice(lo, lo + step)
                low, high = bounds(x[part], distances(x[part], pivots.value), table)
                order = high.argsort(axis=1)
                held = table["c"][order].cumsum(axis=1)
                enough = np.minimum((held < k + 1).sum(axis=1), held.shape[1] - 1)  # cells up to here hold k others
                most = np.take_along_axis(high, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
                most = np.where(held[:, -1] < k + 1, np.inf, most)
                most = np.fmin(most, limit[part])
                may = low <= most[:, None] * (1 + 1e-12) + 1e-300
                may[np.arange(len(low)), home[part]] = False
                row, c = np.nonzero(may)
                rows_out = batch.slice(lo, len(low)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([rows_out.column(rid), rows_out.column("f"), pa.array([table["names"][i] for i in c.tolist()], pa.string())],
                                                 names=[rid, "f", "cell"])

    visits = T.StructType([base.schema[rid], base.schema["f"]]).add("cell", "string")
    look = written(asked.select(rid, "f", "cell", "kd").mapInArrow(outside, visits))
    chunks = look.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))  # a row a cell
    look = look.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64(rid), F.col("chunks")).cast("int")).drop("chunks")
    shown = rows.select(F.col(rid), "f", "cell").join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def across(queries: pa.Table, group: pa.Table) -> pa.Table:
        return _near(queries, group.sort_by(rid), d, k, rid)

    others = look.groupBy("cell", "chunk").cogroup(shown.withColumnsRenamed({"cell": "cell2", "chunk": "chunk2"}).groupBy("cell2", "chunk2")).applyInArrow(across, found)
    w = Window.partitionBy(rid)
    best = own.unionByName(others).withColumn("_r", F.row_number().over(w.orderBy("d", "o"))).where(F.col("_r") <= k)
    return written(best.select(rid, F.col("o").alias("_o"), F.col("d").alias("_d"), F.max("d").over(w).alias("_kdist")))
