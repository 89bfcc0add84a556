"""Local outlier factor inside blocks (default block = one store-department series).

Exact k-nearest neighbours without emitting all pairs of a block:

* rows of a block are sorted by one feature ``u``; each row takes the rows within
  +-m positions as candidates (a window ``collect_list``), keeps the k nearest
  (self excluded, ties broken by the neighbour key);
* the answer is *certified* when the k-distance is no larger than the gap in ``u``
  to the first row outside the window on each side: every row outside is at
  least that far away, so none can be nearer;
* rows that are not certified are recomputed with a doubled m, until none is
  left (m never needs to exceed the block size).

Then k-distance, reachability distance max(k-dist(o), d(p, o)), local reachability
density 1 / (mean reach + 1e-10) and LOF = mean lrd(neighbours) / lrd(p) are joins
and grouped means over the (row, neighbour) table, which has k rows per row.
LOF is reported to 8 decimals, so that the flag (LOF above the (1 - contamination)
quantile) does not depend on the last bits of a floating sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.numeric import snap8
from tillcast.session import written


def _knn(df: DataFrame, block: list[str], rid: str, u: str, feats: list[str], k: int, m: int,
         pending: DataFrame | None = None) -> DataFrame:
    """One round: candidates within +-m sorted positions; distances only for ``pending`` rows."""
    w = Window.partitionBy(*block).orderBy(u, rid)
    if pending is not None:
        # Only stretches of m rows around pending rows take part: a row further than m
        # positions from every pending row can be in none of their lists.
        df = (df.join(pending.withColumn("_todo", F.lit(1)), [*block, rid], "left")
              .withColumn("_near", F.max("_todo").over(w.rowsBetween(-m - 1, m + 1))))
        df = df.where("_near = 1")
    cand = F.collect_list(F.struct(F.col(rid).alias("o"), F.col("_f").alias("f"))).over(w.rowsBetween(-m, m))
    if pending is not None:
        cand = F.when(F.col("_todo") == 1, cand)
    out = df.select(*block, rid, u, "_f", "_n", cand.alias("_c"),
                    F.lag(u, m + 1).over(w).alias("_lo"), F.lead(u, m + 1).over(w).alias("_hi"))
    if pending is not None:
        out = out.join(pending, [*block, rid], "left_semi")
    d = len(feats)

    def dist(c):
        return F.sqrt(sum(((c["f"][i] - F.col("_f")[i]) * (c["f"][i] - F.col("_f")[i]) for i in range(d)),
                          F.lit(0.0)))

    pairs = F.transform(F.filter("_c", lambda c: c["o"] != F.col(rid)),
                        lambda c: F.struct(dist(c).alias("d"), c["o"].alias("o")))
    keff = F.least(F.lit(k), F.col("_n") - 1).cast("int")
    out = out.withColumn("_nb", F.slice(F.array_sort(pairs), 1, F.greatest(keff, F.lit(1)))).drop("_c")
    kd = F.when(keff >= 1, F.element_at("_nb", F.greatest(keff, F.lit(1)))["d"])
    ok = ((F.col("_lo").isNull() | (F.col(u) - F.col("_lo") >= kd))
          & (F.col("_hi").isNull() | (F.col("_hi") - F.col(u) >= kd)))
    return out.withColumn("_kdist", kd).withColumn("_ok", ok | (F.lit(2 * m + 1) >= F.col("_n")))


def knn_blocked(df: DataFrame, block: list[str], rid: str, feats: list[str], k: int = 40,
                u: str | None = None, m0: int | None = None) -> DataFrame:
    """Flat exact k-NN table (block, rid, _o, _d, _kdist): k rows per row.

    Neighbour lists are exploded before a round is written, so the tables
    hold primitive columns only.
    """
    u = u or feats[0]
    base = df.select(*block, rid, *feats).withColumn(
        "_f", F.array(*[F.col(c).cast("double") for c in feats])) \
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*block)))
    base = written(base)
    max_n = base.agg(F.max("_n")).first()[0] or 1
    m = m0 or 2 * k
    parts, pending = [], None
    while True:
        r = _knn(base, block, rid, u, feats, k, m, pending)
        r = r.select(*block, rid, "_kdist", "_ok", F.posexplode("_nb").alias("_i", "_e")).select(
            *block, rid, "_kdist", "_ok", "_i", F.col("_e.o").alias("_o"), F.col("_e.d").alias("_d"))
        r = written(r)  # iterative: cut the lineage each round
        left = r.where(~F.col("_ok") & (F.col("_i") == 0)).count()
        last = left == 0 or 2 * m + 1 >= max_n
        keep = r if last else r.where("_ok")
        parts.append(keep.select(*block, rid, "_o", "_d", "_kdist"))
        if last:
            out = parts[0]
            for p_ in parts[1:]:
                out = out.unionByName(p_)
            return out
        pending = r.where(~F.col("_ok") & (F.col("_i") == 0)).select(*block, rid)
        m *= 2


def _scores(pairs: DataFrame, block: list[str], rid: str) -> DataFrame:
    """(block, rid, lof) of a neighbour table (block, rid, _o, _d, _kdist)."""
    kd = pairs.select(*block, F.col(rid).alias("_o"), F.col("_kdist").alias("_kdo")).distinct()
    reach = pairs.join(kd, [*block, "_o"]).withColumn("_reach", F.greatest("_kdo", "_d"))
    lrd = reach.groupBy(*block, rid).agg((F.lit(1.0) / (F.avg("_reach") + F.lit(1e-10))).alias("_lrd"))
    lrd_o = lrd.select(*block, F.col(rid).alias("_o"), F.col("_lrd").alias("_lrdo"))
    return (pairs.join(lrd_o, [*block, "_o"]).groupBy(*block, rid).agg(F.avg("_lrdo").alias("_m"))
            .join(lrd, [*block, rid]).select(*block, rid, snap8(F.col("_m") / F.col("_lrd")).alias("lof")))


def _flagged(df: DataFrame, lof: DataFrame, on: list[str], contamination: float) -> DataFrame:
    from tillcast.functions.quantiles import exact_quantiles
    out = written(df.join(lof, on, "left"))
    cut = exact_quantiles(out, ["lof"], [1.0 - contamination])["lof"][0]
    flag = F.coalesce((F.col("lof") > F.lit(cut)).cast("int"), F.lit(0)) if cut is not None else F.lit(0)
    return out.withColumn("lof_anomaly", flag)


def lof_blocked(df: DataFrame, block: list[str], rid: str, feats: list[str], k: int = 40,
                contamination: float = 0.005, u: str | None = None) -> DataFrame:
    """Adds ``lof`` (null for one-row blocks) and ``lof_anomaly`` to ``df``."""
    return _flagged(df, _scores(knn_blocked(df, block, rid, feats, k, u), block, rid), [*block, rid], contamination)


def lof_all(df: DataFrame, rid: str, feats: list[str], k: int = 40, contamination: float = 0.005, cell_rows: int = 2000) -> DataFrame:
    """The factor with neighbours among all rows: adds ``lof`` and ``lof_anomaly`` to ``df``.

    Exact (``neighbours.nearest_all``); ``rid`` names each row once. Rows with a null
    feature have no factor and no flag.
    """
    from tillcast.operators.neighbours import nearest_all
    return _flagged(df, _scores(nearest_all(df, rid, feats, k, cell_rows), [], rid), [rid], contamination)
