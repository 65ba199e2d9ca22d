"""Shared plumbing of the corpus operators: tables, scratch tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII white space, the separator set of every word contract.
SPACE = " \t\n\x0b\x0c\r"
#: Splits of the default size up to which a table counts as small.
SMALL_SPLITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Up to SMALL_SPLITS file splits, about 1 GB, are dealt out over the cores; what is larger is never moved."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    splits, cores = df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if splits < min(cores, SMALL_SPLITS + 1) else df


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without: it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='archloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(spark: SparkSession) -> int:
    """Files of a table that is small against what was shuffled for it: half of the shuffle's partitions, but one for each core.
    Each file costs its task several calls of the file system, on a local one several processes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)


def materialise_few(df: DataFrame) -> DataFrame:
    """materialise, in few files."""
    return materialise(df.coalesce(few_files(df.sparkSession)))


#: Rows in an Arrow batch of texts: the default of 10,000 holds tens of MB in several buffers of each task.
BATCH_ROWS = 1000


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of the input can't clash with an operator's own.

    Also bounds the session's Arrow batches, which from here on carry whole texts.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.select(*[F.col(c) for c in columns])


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type of a column, for ids that pass through Python."""
    return to_arrow_type(df.schema[column].dataType)


def byte_rows(batches: Iterator[pa.RecordBatch], id_column: str, text_column: str, limit: int = 1 << 18) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and UTF-8 texts (null: empty) in slices of about `limit` bytes; a longer text comes alone."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        keys = batch.column(id_column).to_pylist()
        column = batch.column(text_column).cast(pa.large_binary())
        for i, key in enumerate(keys):
            text = column[i].as_py() or b""
            if texts and size + len(text) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(text)
            size += len(text)
    if ids:
        yield ids, texts


def text_rows(batches: Iterator[pa.RecordBatch], id_column: str, text_column: str, rows: int = 256) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts (null: empty) in slices of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(id_column).to_pylist(), [t or "" for t in part.column(text_column).to_pylist()]
