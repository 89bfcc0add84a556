"""Helpers shared by the text operators: Arrow chunks, scratch tables, splits."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillcast.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 18  # text handled at once inside a task; a longer document is a chunk of its own


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python 1,000 at a time, unless the session says otherwise.

    The default of 10,000 rows holds tens of MB for each task on either side.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables written to the shared checkpoint folder, to cut lineage.

    They survive the loss of executors. ``drop`` deletes those no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df, return it as read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that ``keep`` returned."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for f in frames:
            path = jvm.org.apache.hadoop.fs.Path(f._scratch_path)
            path.getFileSystem(conf).delete(path, True)


class Chunk:
    """Consecutive rows of a batch and their texts as one run of UTF-8 bytes."""

    def __init__(self, start: int, stop: int, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray):
        self.start, self.stop, self.data, self.offsets, self.valid = start, stop, data, offsets, valid

    def __len__(self) -> int:
        return self.stop - self.start

    def chars(self) -> tuple[str, np.ndarray]:
        """All texts as one string, and where each starts in it (n + 1 places)."""
        whole = self.data.tobytes().decode("utf-8")
        if len(whole) == len(self.data):
            return whole, self.offsets
        heads = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return whole, heads[self.offsets]


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text array into chunks of about ``limit`` bytes; null counts as empty."""
    n = len(texts)
    if not n:
        return
    valid = np.asarray(pc.is_valid(texts).to_numpy(zero_copy_only=False), bool)
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, off, raw = arr.buffers()
    offs = np.frombuffer(off, np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield Chunk(start, stop, data[offs[start]:offs[stop]], offs[start:stop + 1] - offs[start], valid[start:stop])
        start = stop


def with_text_columns(df: DataFrame, text: str, schema: str | T.StructType,
                      maker: Callable[[], Callable[[Chunk], list[pa.Array]]]) -> DataFrame:
    """df with the columns of ``schema``, computed in tasks from the text of each row.

    ``maker()`` is called once in a task; what it returns turns a chunk into one
    array for each new column. Columns of df with a new column's name are replaced.
    """
    new = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kept = [c for c in df.columns if c not in new.names]
    hidden = text not in kept  # the text column itself is replaced
    src = df.select(*[col(c) for c in kept], *([col(text)] if hidden else []))
    at = (kept + [text]).index(text)
    out = T.StructType([df.schema[c] for c in kept] + new.fields)
    small_batches(df.sparkSession)
    n_kept = len(kept)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        target = to_arrow_schema(out)
        make = maker()
        for batch in batches:
            for chunk in text_chunks(batch.column(at)):
                rows = batch.slice(chunk.start, len(chunk))
                made = make(chunk)
                cols = [rows.column(i) for i in range(n_kept)] + list(made)
                yield pa.RecordBatch.from_arrays(
                    [c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, target)],
                    names=target.names)

    return src.mapInArrow(run, out)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(col(doc_id).cast("string")), F.lit(n))


def agreed_labels(labels: DataFrame, key: str) -> DataFrame:
    """One row a key: repeated labels count once, a key with labels that contradict each other is left out."""
    label = next(c for c in labels.columns if c != key)
    one = labels.groupBy(col(key)).agg(F.min(col(label)).alias(label), F.max(col(label)).alias("__most"))
    return one.where(col(label) == F.col("__most")).drop("__most")


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, max_rows: int) -> DataFrame:
    """docs joined with about ``max_rows`` rows of labels at most, chosen by a hash of the key.

    Labels are sampled before the join, so that no text is shuffled: what is broadcast
    has a row for each sampled label and no more. Repeated labels of a key count once; a
    key with labels that contradict each other teaches nothing.
    """
    labels = agreed_labels(labels, key)
    n = labels.count()
    cut = math.floor(min(1.0, max_rows / max(n, 1)) * (1 << 40))
    few = labels.where(F.pmod(F.xxhash64(F.lit("labels"), col(key)), F.lit(1 << 40)) < cut)
    return docs.join(F.broadcast(few), key)


def bounded_sample(df: DataFrame, key: str, text: str, max_rows: int, max_bytes: int) -> DataFrame:
    """About ``max_rows`` rows at most, and ``max_bytes`` of text, chosen by a hash of the key.

    One aggregate over the lengths sets the share; nothing is cut inside a text.
    """
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(col(text))).alias("b")).first()
    n, size = got["n"] or 0, got["b"] or 0
    share = min(1.0, max_rows / n if n else 1.0, max_bytes / size if size else 1.0)
    if share >= 1:
        return df
    cut = math.floor(share * (1 << 40))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), col(key)), F.lit(1 << 40)) < cut)


def sample_by_label(df: DataFrame, key: str, text: str, label: str, max_rows: int, max_bytes: int,
                    max_labels: int) -> tuple[DataFrame, dict[str, int]]:
    """A bounded sample in which every label has an equal part of the bounds, and the rows of each label in df.

    A rare label is taken whole as long as it fits its part. More than ``max_labels``
    labels are an error: what is learned of them would have no bound.
    """
    stats = (df.groupBy(col(label).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(col(text))).alias("b"))
             .orderBy("l").limit(max_labels + 1).collect())
    if len(stats) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    part = max(len(stats), 1)
    share = {r.l: min(1.0, max_rows / part / r.n, max_bytes / part / r.b if r.b else 1.0) for r in stats}
    if stats and min(share.values()) < 1:
        cuts = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(math.floor(v * (1 << 40))))])
        df = df.where(F.pmod(F.xxhash64(F.lit("sample"), col(key)), F.lit(1 << 40)) < cuts[col(label).cast("string")])
    return df, {r.l: r.n for r in stats}
