"""Session helpers: a local session for tests/bench and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "tillcast") -> SparkSession:
    """Session for tests and the local bench. On a cluster, build your own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose driver and
    executors are one process (``local[...]``) may go without: it gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="tillcast-ckpt-", dir="/tmp")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


_TABLES: dict[str, list[str]] = {}  # by application: folders to delete


def remember(spark: SparkSession, path: str) -> str:
    """Note a folder of intermediate tables, for ``drop_written``."""
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediate tables that this session's queries have written so far; how many.

    Results made from them can no longer be read: call it once they are stored or collected.
    """
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        if name.startswith("layer_"):
            spark.sql(f"drop table if exists {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder: computed once, lost with no executor, nothing cached.

    The folder stays until ``drop_written``.
    """
    path = remember(df.sparkSession, f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a session started without it on their path."""
    import shutil
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="tillcast-"), "tillcast")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", home, "tillcast"))


def bucketed(df: DataFrame, keys: list[str], order: str | None = None, buckets: int | None = None) -> DataFrame:
    """df as a table bucketed by ``keys`` and sorted by them and ``order``, in the shared checkpoint folder.

    Windows, joins and aggregates on the keys read it without an exchange. ``buckets``
    should be a few times the cluster's cores; it defaults to the session's shuffle partitions.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"layer_{uuid.uuid4().hex}"
    path = remember(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    one_file_a_bucket = df.repartition(n, *keys)
    one_file_a_bucket.write.bucketBy(n, *keys).sortBy(*keys, *([order] if order else [])).option("path", path).saveAsTable(name)
    return spark.table(name)
