"""Queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, decontam, langid, lines, nearest, pii, quality, sharding, simhash, spelling, suffix, toxicity
from .common import read


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": langid.op1_langid,
    "op2_simhash": simhash.op2_simhash,
    "op3_nearest": nearest.op3_nearest,
    "op4_repeats": suffix.op4_repeats,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": op6_pii,
    "op7_decontam": decontam.op7_decontam,
    "op8_quality": quality.op8_quality,
    "op9_bpe": bpe.op9_bpe,
    "op10_sharding": op10_sharding,
    "op11_lines": lines.op11_lines,
    "op12_spelling": spelling.op12_spelling,
    "op13_align": align.op13_align,
}

ORACLE: dict[str, str] = {"op11_lines": lines.OP11_SQL}
