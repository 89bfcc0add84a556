"""Exact quantiles of large groups, one path for every size, read inside Spark.

Pass 1: one sketch per group gives approximate values on an even grid of ranks.
Each wanted quantile gets a band of its own: the grid cells around its rank, wider
by one rank and by the sketch's error. Pass 2: rows below a band are only counted,
rows inside are counted by value, both with map-side combine; a running sum over a
band's distinct values (a few thousandths of a group) finds the values at the two
neighbouring ranks, interpolated linearly as ``percentile`` and ``quantile_cont``
do. A band of more than ``BAND`` distinct values is narrowed first: a sketch over its own
values cuts it into cells, whose counts tell which cells hold the ranks, and the rows
below those are merged into one; again, until the band is small. The result is a DataFrame with one row per group; no value passes through the
driver. A rank outside its band raises an error, below as well as above.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import written

GRID = 1000
BAND = 100_000  # distinct values of a band that one task sorts at most


def _narrow(counts: DataFrame, by: list[str], qs: list[float], accuracy: int) -> DataFrame:
    """counts (by, _n, _i, _v, _k) with only the cells of each band that hold its ranks; all below them is one row without a value."""
    key = [*by, "_i"]
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(key)]
    cuts = counts.where("_v is not null").groupBy(*key).agg(
        F.percentile_approx("_v", [i / GRID for i in range(1, GRID)], accuracy).alias("_cuts")).select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(key)], F.array_distinct("_cuts").alias("_cuts"))
    placed = counts.join(cuts, on, "left").select(
        *key, "_n", "_v", "_k", F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).alias("_cell"))
    cells = placed.groupBy(*key, "_n", "_cell").agg(F.sum("_k").alias("_c"))  # GRID and one a band
    before = F.sum("_c").over(Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    pos = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_i") + 1)
    cells = cells.withColumn("_low", before)
    held = F.lit(False)
    for rank in (F.floor(pos), F.ceil(pos)):
        held |= (F.col("_low") <= rank) & (rank < F.col("_low") + F.col("_c"))
    cells = cells.withColumn("_held", held)
    first = F.min(F.when(F.col("_held"), F.col("_cell"))).over(Window.partitionBy(*key))
    kept = cells.withColumn("_first", first).where(F.col("_held") | (F.col("_cell") < F.col("_first")))
    kept = kept.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(key)], F.col("_cell").alias("_kept"), "_held")
    met = placed.join(kept, [*on, F.col("_cell") == F.col("_kept")])
    value = F.when(F.col("_held"), F.col("_v"))
    return met.groupBy(*key, "_n", value.alias("_v")).agg(F.sum("_k").alias("_k")).select(*by, "_n", "_i", "_v", "_k")


def exact_group_quantiles(df: DataFrame, by: list[str], col: str, qs: list[float],
                          accuracy: int = 10000) -> DataFrame:
    """(by..., q0, q1, ...): exact quantiles of ``col`` per group; nulls are left out.

    A group without values has no row. ``accuracy`` is the sketch's: band width and
    memory change with it, results do not.
    """
    x = F.col("_x")
    src = df.select(*by, F.col(col).cast("double").alias("_x")).where(x.isNotNull())
    grid = [i / GRID for i in range(GRID + 1)]
    sketch = src.groupBy(*by).agg(F.count(x).alias("_n"), F.percentile_approx(x, grid, accuracy).alias("_g"))
    margin = F.ceil(F.lit(float(GRID)) / F.col("_n")).cast("int") + F.lit(1 + math.ceil(GRID / accuracy))
    bands = []
    for i, q in enumerate(qs):
        lo = F.lit(math.floor(q * GRID)) - margin
        hi = F.lit(math.ceil(q * GRID)) + margin
        bands += [F.when(lo > 0, F.get("_g", lo)).otherwise(F.lit(float("-inf"))).alias(f"_lo{i}"),
                  F.when(hi < GRID, F.get("_g", hi)).otherwise(F.lit(float("inf"))).alias(f"_hi{i}")]
    rows = src.join(sketch.select(*by, "_n", *bands), by)
    # NaN sorts above infinity in Spark, so "not above the band" keeps it in an open band
    held = [F.when((x <= F.col(f"_hi{i}")) | (F.col(f"_hi{i}") == float("inf")),
                   F.struct(F.lit(i).alias("i"), F.when(x >= F.col(f"_lo{i}"), x).alias("v"))) for i in range(len(qs))]
    counts = (rows.select(*by, "_n", F.explode(F.array_compact(F.array(*held))).alias("_h"))
              .groupBy(*by, "_n", F.col("_h.i").alias("_i"), F.col("_h.v").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_k")))
    counts = written(counts)
    while (counts.groupBy(*by, "_i").agg(F.count("_v").alias("_c")).agg(F.max("_c")).first()[0] or 0) > BAND:
        counts = written(_narrow(counts, by, qs, accuracy))
    order = Window.partitionBy(*by, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_to", F.sum("_k").over(order))
    picks = []
    for i, q in enumerate(qs):
        pos = (F.col("_n") - 1) * F.lit(q)
        for name, rank in (("a", F.floor(pos)), ("b", F.ceil(pos))):
            here = (F.col("_i") == i) & (F.col("_to") > rank) & (F.col("_to") - F.col("_k") <= rank)
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}{i}"))
    got = counts.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for i, q in enumerate(qs):
        pos = (F.col("_n") - 1) * F.lit(q)
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        value = F.when(a == b, a).otherwise(a + (pos - F.floor(pos)) * (b - a))
        out.append(F.coalesce(value, F.raise_error(F.lit("rank outside its band")).cast("double")).alias(f"q{i}"))
    return got.select(*by, *out)


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], accuracy: int = 10000) -> dict:
    """{col: [quantile for q in qs]} (None for an all-null column): len(cols) rows reach the driver."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)])).alias("s"))
    got = exact_group_quantiles(long.select("s.c", "s.x"), ["c"], "x", qs, accuracy).collect()
    found = {r["c"]: [r[f"q{k}"] for k in range(len(qs))] for r in got}
    return {c: found.get(i, [None] * len(qs)) for i, c in enumerate(cols)}
