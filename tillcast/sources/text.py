"""Old result files: arrays stored as text in CSV cells.

Two layouts occur: a bracketed, space-separated vector ("[1.5 2.5]") and a
printed series, one "date value" pair per line. Both are parsed with built-in
string functions and ``posexplode`` (no Python).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_text(values: Column) -> Column:
    """array<double> -> "[v1 v2 ...]" with two decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.format_string("%.2f", v)), " "),
                    F.lit("]"))


def series_text(dates: Column, values: Column) -> Column:
    """parallel arrays -> "yyyy-MM-dd v" lines."""
    return F.array_join(F.transform(F.arrays_zip(dates.alias("d"), values.alias("v")),
                                    lambda z: F.concat_ws(" ", F.date_format(z["d"], "yyyy-MM-dd"),
                                                          F.format_string("%.2f", z["v"]))),
                        "\n")


def parse_vector(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(keys, pos, value) from a bracketed vector text column (pos is 0-based)."""
    body = F.trim(F.regexp_replace(F.col(col), r"[\[\]]", ""))
    return df.select(*keys, F.posexplode(F.split(body, r"\s+")).alias("pos", "_t")) \
             .select(*keys, "pos", F.col("_t").cast("double").alias("value"))


def parse_series(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(keys, pos, date, value) from "date value" lines."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(col), "\n")).alias("pos", "_l"))
    parts = F.split(F.trim("_l"), r"\s+")
    return lines.select(*keys, "pos", F.to_date(parts[0]).alias("date"), parts[1].cast("double").alias("value"))
