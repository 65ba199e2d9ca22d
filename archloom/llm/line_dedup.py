"""Corpus-wide removal of repeated lines, over levelled sorted runs of line hashes.

Documents come in batches. A batch's lines are reduced to (128-bit key hash, number of documents); it is
merge-anti-joined with the saturated run, which holds the keys that already reached the limit, and what is left
is added as a sorted run of level 0. When a level is full its runs are merged into one run of the next level,
and keys that reach the limit by the merge move to the saturated run. A last merge of all levels gives the exact
set of frequent keys. Runs are bucketed by their hashes and sorted, so a batch is shuffled once, when it is laid out like them, and
neither the anti-joins nor the merges shuffle. Runs outlive a call: `state` names them, `restore` takes them up, and a later batch
is added to them. Texts are never shuffled unless the frequent set is too large to send to every executor.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.llm.common import few_files, materialise_few, only, scratch_root

STRIP = b" \t\n\x0b\x0c\r"
COUNTS = "batch int, h1 long, h2 long, n long"


def hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as two columns of signed longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=np.int64).reshape(-1, 2)


def key_of(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, bytes]]:
    values = batch.column(column).cast(pa.large_binary())
    for i in range(len(values)):
        yield i, values[i].as_py() or b""


class LineRuns:
    """Levelled runs of (h1, h2, n) in the shared folder, as tables bucketed by (h1, h2) and sorted within buckets."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int | None = None) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or few_files(spark)
        self.levels: list[list[str]] = [[]]
        self.saturated: list[str] = []

    def state(self) -> dict:
        """What names the runs, for a later session."""
        return {"min_docs": self.min_docs, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels, "saturated": self.saturated}

    @classmethod
    def restore(cls, spark: SparkSession, state: dict) -> "LineRuns":
        runs = cls(spark, state["min_docs"], state["fanout"], state["buckets"])
        runs.levels, runs.saturated = [list(level) for level in state["levels"]], list(state["saturated"])
        return runs

    def add(self, batch: DataFrame) -> None:
        """Adds the counts (h1, h2, n) of a batch of documents."""
        for run in self.saturated:
            batch = batch.join(self.table(run).hint("merge").select("h1", "h2"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self.write(batch.groupBy("h1", "h2").agg(F.sum("n").alias("n"))))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def frequent(self) -> DataFrame:
        """Merges every level; the keys in at least min_docs documents. One that saturated early may come twice."""
        found = self._merged([run for level in self.levels for run in level]).where(F.col("n") >= self.min_docs).select("h1", "h2")
        for run in self.saturated:
            found = found.unionByName(self.table(run).select("h1", "h2"))
        return found

    def laid_out(self, counts: DataFrame) -> DataFrame:
        """Counts dealt like the runs: the one shuffle of a batch."""
        return counts.repartition(self.buckets, "h1", "h2")

    def write(self, run: DataFrame) -> str:
        """A run as a table of its own; gives its place."""
        path = f"{scratch_root(self.spark)}/run-{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("compression", "zstd").saveAsTable(_name(path), format="parquet")
        return path

    def table(self, path: str) -> DataFrame:
        """A run; where the session doesn't know it yet, its bucketing is declared anew."""
        if not self.spark.catalog.tableExists(_name(path)):
            self.spark.sql(f"CREATE TABLE `{_name(path)}` (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(_name(path))

    def _merged(self, runs: list[str]) -> DataFrame:
        """The sums over runs, two at a time by a merge join; as all are laid out alike, each bucket is merged where it is."""
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        first, *rest = runs
        for number, run in enumerate(rest, 1):
            other = self.table(run).withColumnRenamed("n", "m")
            both = self.table(first).hint("merge").join(other, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
            if number == len(rest):
                return both
            first = self.write(both)
        return self.table(first)

    def _compact(self, level: int) -> None:
        merged = self._merged(self.levels[level])
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.saturated.append(self.write(merged.where(F.col("n") >= self.min_docs)))
        self.levels[level + 1].append(self.write(merged.where(F.col("n") < self.min_docs)))
        self.levels[level] = []
        if len(self.saturated) >= self.fanout:
            self.saturated = [self.write(self._merged(self.saturated))]


def _name(path: str) -> str:
    return "archloom_" + path.rsplit("/", 1)[1].replace("-", "_")


def key_counts(docs: DataFrame, text_column: str, min_chars: int, batches: int = 1, most_keys: int = 100_000) -> DataFrame:
    """(batch, h1, h2, n): in how many documents that a task has read one after the other a key was; a key may come again.
    A row's batch is drawn from its text's hash. A task holds `most_keys` keys and those of one text."""

    def rows(seen: list[Counter[bytes]]) -> Iterator[pa.RecordBatch]:
        for at, counter in enumerate(seen):
            if counter:
                h = hashes(list(counter))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), at, dtype=np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(counter.values()), type=pa.int64())], names=["batch", "h1", "h2", "n"])
                counter.clear()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter[bytes]] = [Counter() for _ in range(batches)]
        for part in parts:
            for _, text in texts_of(part, text_column):
                keys = {key_of(line) for line in text.split(b"\n")}
                seen[xxhash.xxh3_64_intdigest(text) % batches if batches > 1 else 0].update(k for k in keys if k and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars))
                if sum(map(len, seen)) >= most_keys:
                    yield from rows(seen)
        yield from rows(seen)

    return only(docs, text_column).mapInArrow(count, COUNTS)


def line_dedup(docs: DataFrame, text_column: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 3, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Removes every line whose key is found in at least `min_docs` documents.

    A key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of fewer than `min_chars` code
    points never count; blank lines stay. Each row is a document, whatever its id: repeated rows count each. A null or
    empty text is one empty line and comes out as an empty text. A very long text is held whole by its task, with 16 bytes for
    each of its lines. An empty table gives an empty result.

    Returns the columns of `docs` with the text replaced, and n_lines, n_dropped (columns of that name in `docs`
    give way). Up to `broadcast_keys` frequent keys (16 bytes each) are sent to the executors; beyond that,
    the dropped line numbers are found by a shuffled join, with the same result.
    """
    runs = LineRuns(docs.sparkSession, min_docs)
    counts = runs.laid_out(key_counts(docs, text_column, min_chars, batches)).groupBy("batch", "h1", "h2").agg(F.sum("n").alias("n"))
    counts = runs.table(runs.write(counts))  # the texts are read once; each batch is a part of this table, laid out like the runs
    for batch in range(batches):
        runs.add(counts.where(F.col("batch") == batch).select("h1", "h2", "n"))
    return without_lines(docs, materialise_few(runs.frequent()), text_column, broadcast_keys)


def add_batch(runs: LineRuns, docs: DataFrame, text_column: str = "text", min_chars: int = 1) -> None:
    """Adds the lines of a further batch of documents to stored runs."""
    runs.add(runs.laid_out(key_counts(docs, text_column, min_chars)).select("h1", "h2", "n"))


def without_lines(docs: DataFrame, frequent: DataFrame, text_column: str = "text", broadcast_keys: int = 1_000_000) -> DataFrame:
    """docs without the lines whose keys are among the frequent ones (h1, h2; materialised). See line_dedup."""
    docs = docs.drop("n_lines", "n_dropped")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if frequent.limit(broadcast_keys + 1).count() <= broadcast_keys:
        known = frequent.toArrow()
        table = np.stack([known["h1"].to_numpy(), known["h2"].to_numpy()], axis=1)
        shared = docs.sparkSession.sparkContext.broadcast(table[np.lexsort((table[:, 1], table[:, 0]))])
        return docs.mapInArrow(lambda parts: (_without(part, text_column, _known(part, text_column, shared.value)) for part in parts), schema)
    return _joined(docs, text_column, frequent, schema)


def _known(part: pa.RecordBatch, text_column: str, table: np.ndarray) -> Iterator[np.ndarray]:
    """For each row, which lines have a key in the sorted table."""
    for _, text in texts_of(part, text_column):
        h = hashes([key_of(line) for line in text.split(b"\n")])
        at = np.searchsorted(table[:, 0], h[:, 0])
        hit = np.zeros(len(h), dtype=bool)
        more = at < len(table)
        while more.any():  # equal first halves stand side by side
            i = np.flatnonzero(more)
            same = table[at[i], 0] == h[i, 0]
            hit[i[same & (table[at[i], 1] == h[i, 1])]] = True
            at[i] += 1
            more[i] = same & ~hit[i] & (at[i] < len(table))
        yield hit


def _without(part: pa.RecordBatch, text_column: str, drops: Iterator[np.ndarray]) -> pa.RecordBatch:
    kept, n_lines, n_dropped = [], [], []
    for (_, text), hit in zip(texts_of(part, text_column), drops, strict=True):
        lines = text.split(b"\n")
        n_lines.append(len(lines))
        n_dropped.append(int(hit.sum()))
        kept.append(b"\n".join(line for line, out in zip(lines, hit.tolist(), strict=True) if not out) if n_dropped[-1] else text)
    arrays = [pa.array(kept, type=pa.binary()).cast(pa.string()) if f.name == text_column else part.column(i) for i, f in enumerate(part.schema)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, type=pa.int64()), pa.array(n_dropped, type=pa.int64())], names=[*part.schema.names, "n_lines", "n_dropped"])


def _joined(docs: DataFrame, text_column: str, frequent: DataFrame, schema: T.StructType) -> DataFrame:
    """The same by joins: line numbers to drop belong to a text, whichever rows hold it. The columns of docs travel in a
    struct, so that none of their names can clash."""
    row = T.StructType(docs.schema.fields)

    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, text in texts_of(part, text_column):
                h, d = hashes([key_of(line) for line in text.split(b"\n")]), xxhash.xxh3_128_digest(text)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(h), type=pa.binary()), pa.array(np.arange(len(h))), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["digest", "i", "h1", "h2"])

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            d = [xxhash.xxh3_128_digest(text) for _, text in texts_of(part, text_column)]
            packed = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
            yield pa.RecordBatch.from_arrays([packed, pa.array(d, type=pa.binary())], names=["row", "digest"])

    def drop(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            numbers = part.column("gone").to_pylist()
            bare = pa.RecordBatch.from_struct_array(part.column("row"))
            hits = []
            for (_, text), out in zip(texts_of(bare, text_column), numbers, strict=True):
                hits.append(np.zeros(text.count(b"\n") + 1, dtype=bool))
                hits[-1][np.array(out or [], dtype=np.int64)] = True
            yield _without(bare, text_column, iter(hits))

    found = only(docs, text_column).mapInArrow(lines, "digest binary, i long, h1 long, h2 long").join(frequent, ["h1", "h2"], "left_semi")
    drops = found.groupBy("digest").agg(F.collect_set("i").alias("gone"))
    marked = docs.mapInArrow(digests, T.StructType([T.StructField("row", row), T.StructField("digest", T.BinaryType())]))
    return marked.join(drops, "digest", "left").select("row", "gone").mapInArrow(drop, schema)
