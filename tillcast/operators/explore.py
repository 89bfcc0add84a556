"""Exploration aggregates: grouped means and sums, top/bottom-k lists and their trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_stats(df: DataFrame, by: list[str], means: list[str] = (), sums: list[str] = ()) -> DataFrame:
    aggs = [F.avg(c).alias(f"avg_{c}") for c in means] + [F.sum(c).alias(f"sum_{c}") for c in sums]
    return df.groupBy(*by).agg(*aggs)


def top_bottom(df: DataFrame, item: str, metric: str, k: int = 3, group: list[str] = (),
               agg: str = "avg") -> DataFrame:
    """Top-k and bottom-k ``item`` by the ``agg`` of ``metric`` inside each group.

    The metric is first reduced to one row per (group, item) with a partial
    aggregate, so the ranking windows only see that small table. Ties break
    by item. Output: group keys, item, value, side ('top' | 'bottom'), rank.
    """
    fn = {"avg": F.avg, "sum": F.sum}[agg]
    per_item = df.groupBy(*group, item).agg(fn(metric).alias("value"))
    w_top = Window.partitionBy(*group).orderBy(F.desc("value"), item) if group else \
        Window.orderBy(F.desc("value"), item)
    w_bot = Window.partitionBy(*group).orderBy(F.asc("value"), item) if group else \
        Window.orderBy(F.asc("value"), item)
    ranked = per_item.select("*", F.row_number().over(w_top).alias("_rt"),
                             F.row_number().over(w_bot).alias("_rb"))
    top = ranked.where(F.col("_rt") <= k).select(*group, item, "value", F.lit("top").alias("side"),
                                                 F.col("_rt").alias("rank"))
    bot = ranked.where(F.col("_rb") <= k).select(*group, item, "value", F.lit("bottom").alias("side"),
                                                 F.col("_rb").alias("rank"))
    return top.unionByName(bot)


def topk_trend(df: DataFrame, item: str, chosen: DataFrame, value: str = "weekly_sales",
               by: str = "week_of_year") -> DataFrame:
    """Weekly trend of the chosen items: left-semi join on a k-row list, then sum.

    ``chosen`` holds at most 2k rows, so broadcasting it is bounded by k.
    """
    keep = F.broadcast(chosen.select(item, "side").distinct())
    return (df.join(keep, item, "inner")
              .groupBy(by, item, "side").agg(F.sum(value).alias("total_sales")))
