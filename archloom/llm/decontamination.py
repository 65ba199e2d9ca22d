"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Benchmark items become windows of words; windows of one length share a scanner. A shift table over blocks of two
words says how far the search may jump; a block that ends some window leads to a bucket of windows by suffix hash, and
direct comparison confirms. The window set is sent to the executors in blocks of bounded size; each block is one
map over the documents, so documents are never shuffled or collected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import arrow_type, byte_rows, materialise, only

#: Bytes to bytes: A-Z to lower case, every other ASCII byte that is no digit or letter to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOUND = "{id} {kind}, n_words long, ranges array<struct<s:int,e:int>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Search for windows of `m` words, given as id sequences; ids start at 1 and 0 is any other word."""

    def __init__(self, windows: list[tuple[int, ...]], m: int, vocabulary: int) -> None:
        self.m, self.base, self.block = m, vocabulary + 1, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        for number, window in enumerate(windows):
            for end in range(self.block, m + 1):
                key = self._key(window, end)
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.buckets[self._key(window, m)].append((window, number))

    def _key(self, ids, end: int) -> int:
        return ids[end - 2] * self.base + ids[end - 1] if self.block == 2 else ids[end - 1]

    def search(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(start, window number) of each occurrence."""
        m, base, far, shift, buckets = self.m, self.base, self.far, self.shift, self.buckets
        end, n, two = m, len(ids), self.block == 2
        while end <= n:
            last = ids[end - 1]
            if not last:  # no window holds this word
                end += m
                continue
            key = ids[end - 2] * base + last if two else last
            step = shift.get(key, far)
            if step:
                end += step
                continue
            start = end - m
            for window, number in buckets[key]:
                if ids[start] == window[0] and tuple(ids[start:end]) == window:
                    yield start, number
            end += 1


class Scanner:
    """All windows of a block of items, grouped by length."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int) -> None:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = defaultdict(set)
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                owners[tuple(ids[at : at + size])].add(item)
        self.vocabulary = vocabulary
        self.classes = []
        for m in sorted({len(w) for w in owners}):
            windows = [w for w in owners if len(w) == m]
            self.classes.append((WuManber(windows, m, len(vocabulary)), [owners[w] for w in windows]))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged word ranges that some occurrence covers, and the items with one."""
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        hits, found = [], set()
        for matcher, owners in self.classes:
            for start, number in matcher.search(ids):
                hits.append((start, start + matcher.m))
                found |= owners[number]
        merged: list[tuple[int, int]] = []
        for s, e in sorted(hits):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, sorted(found - {None})


def covered(ranges: Column) -> Column:
    """Length of the union of ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["to"], r["s"]))).alias("n"), F.greatest(a["to"], r["e"]).alias("to"))
    return F.aggregate(F.array_sort(ranges), start, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Words of each document that an occurrence of a benchmark window covers.

    A window is `size` consecutive words of an item, or the whole item if it has fewer; A-Z count as a-z. Null and
    empty texts have no words; items without words have no windows; windows of items without id hit words, but there is nothing
    to list them by; repeated items count under their id once; a very long text takes as much memory as its words;
    an empty benchmark hits nothing. Every document row gives a row of its own, whatever its id. Items are searched in
    blocks of about `block_bytes` of text; for several blocks, rows are numbered once and merged by number.

    Columns: id, n_words, n_hit, n_items, items (sorted as strings), contaminated.
    """
    docs = only(docs, id_column, text_column).toDF("id", "text")
    blocks = list(item_blocks(benchmark, item_column, item_text, block_bytes))
    if len(blocks) > 1:
        docs = materialise(docs.withColumn("row", F.monotonically_increasing_id()))  # written: each block must see the same numbers
        parts = [_scanned(docs.select("row", "text"), rows, "row", "text", size) for rows in blocks]
        merged = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
        found = merged.join(docs.select("row", "id"), "row")
    else:
        found = _scanned(docs, blocks[0], "id", "text", size)
    items_of = F.array_sort(F.array_distinct("items"))
    counted = found.select(F.col("id").alias(id_column), "n_words", covered(F.col("ranges")).alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"))
    return counted.withColumn("contaminated", F.col("n_hit") > 0)


def item_blocks(benchmark: DataFrame, item_column: str, item_text: str, block_bytes: int) -> Iterator:
    """Broadcasts of [(item, text)], each of about `block_bytes` of text."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_column).cast("string").alias("i"), F.col(item_text).alias("t"))
    blocks = 1 + (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast([(r.i, r.t.encode()) for r in part.collect()])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no benchmark window occurs."""
    for rows in item_blocks(benchmark, item_column, item_text, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(rows.value, size)
            for batch in batches:
                texts = batch.column(text_column).cast(pa.large_binary())
                yield batch.filter(pa.array([not scanner.scan(words_of(t.as_py() or b""))[0] for t in texts], type=pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def _scanned(docs: DataFrame, rows, id_column: str, text_column: str, size: int) -> DataFrame:
    kind, id_type = docs.schema[id_column].dataType.simpleString(), arrow_type(docs, id_column)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rows.value, size)
        for ids, texts in byte_rows(batches, id_column, text_column):
            counts, ranges, items = [], [], []
            for text in texts:
                words = words_of(text)
                hit, found = scanner.scan(words)
                counts.append(len(words))
                ranges.append([{"s": s, "e": e} for s, e in hit])
                items.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=id_type), pa.array(counts, type=pa.int64()), pa.array(ranges, type=pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(items, type=pa.list_(pa.string()))],
                names=[id_column, "n_words", "ranges", "items"],
            )

    return docs.mapInArrow(scan, FOUND.format(id=f"`{id_column}`", kind=kind))
