"""Query registry: key -> (spark, sf_dir) -> DataFrame, plus the oracle SQL per key."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tillcast.sources import fixtures


def _expand(sql: str, name: str, fmt) -> str:
    token = f"{name}("
    i = 0
    while True:
        i = sql.find(token, i)
        if i < 0:
            return sql
        if i > 0 and (sql[i - 1].isalnum() or sql[i - 1] == "_"):
            i += 1
            continue
        depth, j = 0, i + len(name)
        while True:
            if sql[j] == "(":
                depth += 1
            elif sql[j] == ")":
                depth -= 1
                if depth == 0:
                    break
            j += 1
        sql = sql[:i] + fmt(sql[i + len(token):j]) + sql[j + 1:]


def _snap(x: str) -> str:
    return f"(case when abs({x}) < 1e9 then floor(({x}) * 1e8 + 5e-1) / 1e8 else ({x}) end)"


def expand_r4(sql: str) -> str:
    """Rewrite r4(x) / s8(x) into the same engine-neutral rounding as functions.numeric.r4."""
    sql = _expand(sql, "s8", lambda x: f"(floor(({x}) * 1e8 + 5e-1) / 1e8)")
    return _expand(sql, "r4", lambda x: f"(floor({_snap(x)} * 1e4 + 5e-1) / 1e4)")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB oracle (None = rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = expand_r4(sql)
        return fn
    return deco


class Views:
    """The stand-in views of one test-data folder, built lazily (plans, not data)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def sales(self) -> DataFrame:
        return fixtures.sales(self.spark, self.sf_dir)

    @cached_property
    def supplier_sales(self) -> DataFrame:
        return fixtures.sales(self.spark, self.sf_dir, dept_col="p_brand", store_col="s_suppkey")

    @cached_property
    def stores(self) -> DataFrame:
        return fixtures.stores(self.spark, self.sf_dir)

    @cached_property
    def features(self) -> DataFrame:
        return fixtures.features(self.spark, self.sf_dir)

    @cached_property
    def prepared(self) -> DataFrame:
        from tillcast.operators.prepare import prepare
        return prepare(self.sales, self.features, self.stores)

    @cached_property
    def cleaned(self) -> DataFrame:
        from tillcast.operators.anomaly import clean_sales
        return clean_sales(self.prepared)
