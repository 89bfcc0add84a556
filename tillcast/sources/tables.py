"""Typed readers and writers for the raw, processed and result layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.dates import parse_dmy

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# Raw CSV layouts of the reference inputs (header row, dd/MM/yyyy dates).
RAW_SALES = T.StructType([
    T.StructField("Store", T.IntegerType(), False),
    T.StructField("Dept", T.IntegerType(), False),
    T.StructField("Date", T.StringType(), False),
    T.StructField("Weekly_Sales", T.DoubleType(), False),
    T.StructField("IsHoliday", T.BooleanType(), False),
])
RAW_FEATURES = T.StructType([
    T.StructField("Store", T.IntegerType(), False),
    T.StructField("Date", T.StringType(), False),
    T.StructField("Temperature", T.DoubleType(), True),
    T.StructField("Fuel_Price", T.DoubleType(), True),
    *[T.StructField(f"MarkDown{i}", T.DoubleType(), True) for i in range(1, 6)],
    T.StructField("CPI", T.DoubleType(), True),
    T.StructField("Unemployment", T.DoubleType(), True),
    T.StructField("IsHoliday", T.BooleanType(), False),
])
RAW_STORES = T.StructType([
    T.StructField("Store", T.IntegerType(), False),
    T.StructField("Type", T.StringType(), False),
    T.StructField("Size", T.IntegerType(), False),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read one raw CSV with a fixed schema, lower-case names, text dates parsed.

    A missing path raises ``AnalysisException`` (no silent empty result).
    """
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    if "date" in df.columns:
        df = df.withColumn("date", parse_dmy("date"))
    return df.withColumnRenamed("isholiday", "is_holiday")


def write_layer(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write a processed/cleaned/result layer as parquet, partitioned for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_rules(rules: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rule table (antecedents/consequents as ', '-joined text, metrics as doubles)."""
    rules.write.mode(mode).parquet(path)


def write_forecasts(forecasts: DataFrame, metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long forecast rows partitioned by model, plus the metrics table beside them."""
    forecasts.write.mode(mode).partitionBy("model").parquet(f"{path.rstrip('/')}/forecasts")
    metrics.write.mode(mode).parquet(f"{path.rstrip('/')}/metrics")


def write_chain_totals(train: DataFrame, actual_vs_pred: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chain train totals by week and chain actual against predicted by model and week."""
    train.write.mode(mode).parquet(f"{path.rstrip('/')}/chain_train")
    actual_vs_pred.write.mode(mode).partitionBy("model").parquet(f"{path.rstrip('/')}/chain_forecast")


def write_best_models(ranked: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row a series: its best model with metrics (``ranked`` holds is_best)."""
    ranked.where("is_best").select("level", "store", "model", "rmse", "r2").write.mode(mode).parquet(f"{path.rstrip('/')}/best_models")


def load_pipeline(path: str):
    """A fitted MLlib pipeline written by ``save_model``."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def save_model(model, path: str) -> None:
    """Persist a fitted MLlib model or pipeline (replaces pickled estimators)."""
    model.write().overwrite().save(path)


def write_models(table: DataFrame, path: str, mode: str = "append") -> None:
    """Model table (level, store, model, version, params, coef), partitioned by model, so that one model is read alone."""
    table.write.mode(mode).partitionBy("model").parquet(path)


def read_models(spark: SparkSession, path: str, model: str, level: str | None = None, store: int | None = None,
                version: str | None = None) -> DataFrame:
    """The rows of a model table for a model, and if given of one level, store and version."""
    out = spark.read.parquet(path).where(F.col("model") == model)
    for name, value in (("level", level), ("store", store), ("version", version)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
