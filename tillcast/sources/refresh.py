"""A layer kept up to date: new weeks rewrite only the partitions that they reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import written

PART = "part"


def write_parts(df: DataFrame, path: str, part: Column) -> None:
    """df partitioned by ``part`` (a value a row, such as its month); partitions not in df keep their files."""
    (df.withColumn(PART, part).repartition(PART).write.mode("overwrite").partitionBy(PART)
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def reached(source: DataFrame, changed: DataFrame, keys: list[str], order: str, back: int, on: int | None) -> DataFrame:
    """Rows of source needed again, with ``_again``: true where the result may differ, false for mere context.

    ``changed`` (keys, order) are the rows that are new or different in source. Their
    series' rows from the first change to ``on`` rows after the last are due again (None: all
    after it), and the ``back`` rows before are context. Other series are left out.
    """
    span = changed.groupBy(*keys).agg(F.min(order).alias("_from"), F.max(order).alias("_to"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    span = span.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_from", "_to")
    rows = source.join(span, same).drop(*[f"_k_{k}" for k in keys])
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.col(order) < F.col("_from"), F.col(order) > F.col("_to")
    left = F.sum(before.cast("int")).over(w.rowsBetween(1, Window.unboundedFollowing))
    past = F.sum(after.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("*", F.coalesce(left, F.lit(0)).alias("_left"), past.alias("_past"))
    rows = rows.where(~before | (F.col("_left") < back))
    if on is not None:
        rows = rows.where(~after | (F.col("_past") <= on))
    return rows.withColumn("_again", F.col(order) >= F.col("_from")).drop("_from", "_to", "_left", "_past")


def refresh(source: DataFrame, changed: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], part: Column,
            keys: list[str], order: str = "date", back: int = 0, on: int | None = None) -> list:
    """Bring the layer at ``path`` up to date with source; the partitions rewritten.

    ``build`` makes layer rows from source rows, one each, a row's result depending on
    the ``back`` rows of its series before it and no other; a change therefore reaches
    ``on`` = back rows further at most. Rows of source that are gone are not noticed.
    """
    spark = source.sparkSession
    need = written(reached(source, changed, keys, order, back, on))
    due = need.where("_again").select(*keys, order)
    named = [F.col(k).alias(f"_d_{k}") for k in (*keys, order)]
    same = [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in (*keys, order)]
    fresh = build(need.drop("_again")).join(due.select(*named), same, "left_semi")
    fresh = written(fresh.withColumn("_part", part))
    parts = [r[0] for r in fresh.select("_part").distinct().orderBy("_part").collect()]  # months reached
    if parts:
        old = spark.read.parquet(path).where(F.col(PART).isin(parts)).drop(PART)
        kept = old.join(due.select(*named), same, "left_anti")
        write_parts(written(fresh.drop("_part").unionByName(kept)), path, part)
    return parts
