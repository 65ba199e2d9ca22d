"""A source tree that changes. Files that are new, rewritten or gone since the last pass are found by joining the listing
with a table of what was read, and only they are parsed; each pass replaces what its files declared before."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archloom.operators.layers import latest_per
from archloom.sources.files import LANGUAGES, extension
from archloom.sources.parse import DECLARATION, declarations, parse_files
from archloom.tables import saved

#: A row for each file of a pass; gone: it was there before and isn't any more.
FILES = "path string, at timestamp, length long, gone boolean, batch long"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, at, length) of the files below a folder in languages that are read; contents aren't touched."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.where(extension("path").isin(*LANGUAGES)).select("path", F.col("modificationTime").alias("at"), "length")


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def file_states(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each file."""
    return latest_per(_read(spark, f"{out}/files", FILES), ["path"], [F.desc("batch")])


def refresh(spark: SparkSession, folder: str, out: str) -> int:
    """One pass: parses what changed by time or length, notes what is gone, and gives how many files that were.

    A pass writes its declarations first and its file rows last; one that is cut short is just done again.
    """
    before = saved(file_states(spark, out))
    there, old = listing(spark, folder), before.where(~F.col("gone")).select("path", F.col("at").alias("old_at"), F.col("length").alias("old_length"))
    both = there.join(old, "path", "full_outer")
    same = F.col("at").eqNullSafe(F.col("old_at")) & F.col("length").eqNullSafe(F.col("old_length"))
    changed = saved(both.where(~same).select("path", "at", "length", F.col("at").isNull().alias("gone")))
    n = changed.count()
    if not n:
        return 0
    batch = (before.agg(F.max("batch")).first()[0] or 0) + 1
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.decode("content", "UTF-8").alias("content"))
    texts = raw.join(changed.where(~F.col("gone")).select("path"), "path", "left_semi").withColumn("language", F.try_element_at(known, extension("path")))
    declarations(parse_files(texts)).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/declarations/part={batch}")
    changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/files/part={batch}")
    return n


def current(spark: SparkSession, out: str) -> DataFrame:
    """The declarations of the last pass of each file that is still there."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in DECLARATION)}, id string, batch long"
    live = file_states(spark, out).where(~F.col("gone")).select("path", "batch")
    return _read(spark, f"{out}/declarations", schema).join(live, ["path", "batch"], "left_semi")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Passes at an interval, as a stream: its rows are only the clock's, each batch refreshes the tables."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, __: refresh(spark, folder, out)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def latest_change(spark: SparkSession, folder: str) -> float:
    """Seconds since the epoch of the last change below a folder; 0 if it is empty."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return float(raw.agg(F.max(F.unix_micros("modificationTime"))).first()[0] or 0) / 1e6


def wait_for_change(spark: SparkSession, folder: str, since: float, seconds: float = 30.0, every: float = 0.25) -> dict:
    """{changed, mtime} as soon as something below a folder is younger than `since`, or at the deadline; at once for since <= 0."""
    end = time.monotonic() + seconds
    while True:
        now = latest_change(spark, folder)
        if since <= 0 or now > since or time.monotonic() >= end:
            return {"changed": 0 < since < now, "mtime": now}
        time.sleep(every)


def reader(spark: SparkSession, path: str) -> Callable[[], DataFrame]:
    """R2: a function that reads a document table anew at each call, whatever was cached of it."""

    def read() -> DataFrame:
        spark.catalog.refreshByPath(path)
        return spark.read.json(path)

    return read
