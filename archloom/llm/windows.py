"""Windows of a fixed number of symbols, dealt to content-chosen anchors.

A window's anchor is its least gram (by hash, then leftmost). The choice depends on the window's content alone, so equal
windows have equal anchors at equal offsets: two windows can only be equal if their anchors' grams are. Consecutive
windows with the same anchor make a stretch; a text has about one stretch for (size - gram) / 2 symbols, and only
stretches, not windows, travel through the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.llm.common import materialise, materialise_few
from archloom.llm.hashing import BASE, U, digest, mix

LOW = U(0xFFFFFFFF)


class Stretches(NamedTuple):
    """Parallel arrays: text number, first and last window start in the text, hash of the anchor's gram, and 128 bits
    (whole, also) that name the content."""

    text: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    gram: np.ndarray
    whole: np.ndarray
    also: np.ndarray


def stretches(symbols: np.ndarray, content: np.ndarray, start: np.ndarray, end: np.ndarray, size: int, gram: int) -> Stretches:
    """Stretches of the texts at [start, end) of one symbol array; `gram` is a power of two, at most `size`.

    symbols: 64-bit hashes, which only deal windows to anchors; content: what the symbols really are, which names stretches.
    """
    none = np.zeros(0, dtype=np.int64)
    n = len(symbols) - size + 1
    if n <= 0:
        return Stretches(none, none, none, none, none, none)
    g, m = symbols, 1
    while m < gram:
        g = g[:-m] * U(pow(BASE, m, 1 << 64)) + g[m:]
        m *= 2
    g = mix(g)
    key = (g & ~LOW) | np.arange(len(g), dtype=np.uint64)
    span, r = size - gram + 1, 1
    while 2 * r <= span:
        key = np.minimum(key[:-r], key[r:])
        r *= 2
    if r < span:
        key = np.minimum(key[: len(key) - (span - r)], key[span - r :])
    anchor = (key[:n] & LOW).astype(np.int64)
    valid = np.zeros(n, dtype=bool)
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        if e - s >= size:
            valid[s : e - size + 1] = True
    at = np.flatnonzero(valid)
    if not len(at):
        return Stretches(none, none, none, none, none, none)
    text = np.searchsorted(start, at, side="right") - 1
    cut = np.flatnonzero((np.diff(anchor[at]) != 0) | (np.diff(text) != 0))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
    lo, hi, own = at[first], at[last], text[first]
    width = content.itemsize * (content.shape[1] if content.ndim > 1 else 1)
    raw = memoryview(np.ascontiguousarray(content)).cast("B")
    names = b"".join([digest(raw[a:b]) for a, b in zip((lo * width).tolist(), ((hi + size) * width).tolist(), strict=True)])
    whole = np.frombuffer(names, dtype=np.int64).reshape(-1, 2)
    return Stretches(own, lo - start[own], hi - start[own], g[anchor[lo]].view(np.int64), whole[:, 0].copy(), whole[:, 1].copy())


#: Symbols in one go. A longer text is cut, and its stretches with it; cut stretches are unequal to whole ones, so their
#: grams are open and the windows themselves decide.
SEGMENT = 1 << 20


def text_stretches(symbols_of, start: np.ndarray, end: np.ndarray, size: int, gram: int, segment: int = SEGMENT) -> Stretches:
    """Stretches of the texts at [start, end); symbols_of(a, b) gives hashes and contents of the symbols between two places.
    A text that comes alone is read in segments that overlap by all but one symbol of a window."""
    total = int(end[-1])
    if len(start) > 1 or total <= 2 * segment:
        return stretches(*symbols_of(0, total), start, end, size, gram)
    parts = []
    for at in range(0, total - size + 1, segment):
        stop = min(total, at + segment + size - 1)
        s = stretches(*symbols_of(at, stop), np.zeros(1, dtype=np.int64), np.array([stop - at]), size, gram)
        parts.append(s._replace(lo=s.lo + at, hi=s.hi + at))
    return Stretches(*(np.concatenate(c) for c in zip(*parts, strict=True)))


MADE = "k long, lo long, hi long, gram long, whole long, also long, extra boolean"


class Seen:
    """Tells which stretches need no comparing any more: two of their kind were sent by this task before, one of them
    earlier in the corpus. A table of fixed size; what falls out of it is just sent again."""

    def __init__(self, bits: int = 18) -> None:
        size = 1 << bits
        self.mask = U(size - 1)
        self.key, self.also, self.sent = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int8)
        self.k, self.lo = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)

    def extra(self, s: Stretches, k: np.ndarray) -> np.ndarray:
        if not len(k):
            return np.zeros(0, dtype=bool)
        key, also = s.whole, s.also
        ordered = np.arange(len(k)) if (np.diff(k) >= 0).all() else np.lexsort((s.lo, k))
        order = ordered[np.argsort(key[ordered], kind="stable")]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (np.diff(key[order]) != 0) | (np.diff(also[order]) != 0)
        first = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        nth = np.arange(len(order)) - first[run]
        head = order[first]
        slot = (key[head].view(np.uint64) & self.mask).astype(np.int64)
        hit = (self.key[slot] == key[head]) & (self.also[slot] == also[head]) & (self.sent[slot] > 0)
        base = np.where(hit, self.sent[slot], 0)
        before = hit & ((self.k[slot] < k[head]) | ((self.k[slot] == k[head]) & (self.lo[slot] < s.lo[head])))
        out = np.zeros(len(k), dtype=bool)
        out[order] = (base[run] + nth >= 2) & ((nth > 0) | before[run])
        n = np.diff(np.append(first, len(order)))
        self.k[slot], self.lo[slot] = np.where(before, self.k[slot], k[head]), np.where(before, self.lo[slot], s.lo[head])
        self.key[slot], self.also[slot], self.sent[slot] = key[head], also[head], np.minimum(2, base + n)
        return out


def rows_of(s: Stretches, ids: list[int], seen: Seen) -> pa.RecordBatch:
    k = np.array(ids, dtype=np.int64)[s.text]
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(s.lo), pa.array(s.hi), pa.array(s.gram), pa.array(s.whole), pa.array(s.also), pa.array(seen.extra(s, k))], names=["k", "lo", "hi", "gram", "whole", "also", "extra"])


def keyed(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """(_k, _text) with a long key that is unique and ordered as the ids; the flag says whether _k is the id itself.

    Where ids repeat, are null or no integers, rows are numbered by id, then by the text's digest.
    """
    plain = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    if isinstance(docs.schema[id_column].dataType, (T.LongType, T.IntegerType)):
        odd = plain.groupBy("_id").count().where(F.col("_id").isNull() | (F.col("count") > 1))
        if not odd.limit(1).count():
            return plain.select(F.col("_id").cast("long").alias("_k"), "_text"), True
    numbered = plain.orderBy("_id", F.md5("_text")).withColumn("_k", F.monotonically_increasing_id())
    return materialise(numbered), False


FOUND = "k long, lo long, hi long, gram long, again boolean, open boolean"


def met(made: DataFrame) -> DataFrame:
    """Where stretches meet. made: k, lo, hi, gram, whole, also, extra.

    Of a stretch that stands in many texts each task sends two at most to its gram; the others are known to be again
    there, and are dealt out evenly.
    Per gram, equal stretches (by the 128 bits of their contents) form a run in the order of (k, lo). Returned are the stretches that are
    equal to another (again: to an earlier one) and the first of each run whose gram has several runs (open). The
    sorted rows stream through; a worker holds one batch and one row, whatever the size of a run or gram.
    """
    columns = ["gram", "whole", "also", "k", "lo", "hi"]
    place = F.when(F.col("extra"), F.xxhash64("k", "lo")).otherwise(F.col("gram"))
    dealt = made.select(*columns, "extra").repartition(place).sortWithinPartitions(*columns[:5])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row is judged when the row after it is known."""
        held: np.ndarray | None = None  # rows not yet judged: the last row seen, as a 6 x 1 array
        before = None  # (gram, whole, also) of the row before `held`
        first: tuple | None = None  # first row of the run that `held` belongs to, and whether an earlier run has its gram

        def judged(rows: np.ndarray, after: tuple | None):
            nonlocal before, first
            gram, n = rows[0], rows.shape[1]
            same = rows[:3] == np.concatenate([np.array([before or (0, 0, 0)]).T, rows[:3, :-1]], axis=1)
            same_gram, same_run = same[0], same.all(axis=0)
            if before is None:
                same_gram[0] = same_run[0] = False
            same = rows[:3] == np.concatenate([rows[:3, 1:], np.array([after or (0, 0, 0)]).T], axis=1)
            next_gram, next_run = same[0], same.all(axis=0)
            if after is None:
                next_gram[-1] = next_run[-1] = False
            starts = np.flatnonzero(~same_run)
            parts = []
            if (same_run | next_run).any():
                i = np.flatnonzero(same_run | next_run)
                parts.append((rows[:, i], same_run[i], np.zeros(len(i), dtype=bool)))
            # runs that end here: their first row is open if the gram has a run before or after
            ends = np.flatnonzero(~next_run)
            run = np.searchsorted(starts, ends, side="right") - 1
            inside = run >= 0
            s = starts[run[inside]]
            is_open = same_gram[s] | next_gram[ends[inside]]
            if is_open.any():
                i = s[is_open]
                parts.append((rows[:, i], np.zeros(len(i), dtype=bool), np.ones(len(i), dtype=bool)))
            if (~inside).any() and first is not None and (first[1] or next_gram[ends[~inside]][0]):
                parts.append((first[0], np.zeros(1, dtype=bool), np.ones(1, dtype=bool)))
            if len(starts):
                first = (rows[:, starts[-1] : starts[-1] + 1].copy(), bool(same_gram[starts[-1]]))
            before = tuple(rows[:3, n - 1].tolist())
            for r, again, is_open in parts:
                yield pa.RecordBatch.from_arrays([pa.array(r[3]), pa.array(r[4]), pa.array(r[5]), pa.array(r[0]), pa.array(again), pa.array(is_open)], names=["k", "lo", "hi", "gram", "again", "open"])

        for batch in batches:
            if not batch.num_rows:
                continue
            extra = batch.column("extra").to_numpy(zero_copy_only=False)
            if extra.any():
                known = batch.filter(pa.array(extra))
                flags = np.ones(known.num_rows, dtype=bool)
                yield pa.RecordBatch.from_arrays([known.column("k"), known.column("lo"), known.column("hi"), known.column("gram"), pa.array(flags), pa.array(~flags)], names=["k", "lo", "hi", "gram", "again", "open"])
                batch = batch.filter(pa.array(~extra))
                if not batch.num_rows:
                    continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            if rows.shape[1] > 1:
                yield from judged(rows[:, :-1], tuple(rows[:3, -1].tolist()))
            held = rows[:, -1:]
        if held is not None:
            yield from judged(held, None)

    return dealt.mapInArrow(scan, FOUND)


def pieces(found: DataFrame, docs: DataFrame, cut, schema: str) -> DataFrame:
    """The contents of open stretches: (gram, k, lo, piece). cut(text, [(lo, hi)]) gives the pieces of one text."""
    asked = found.where("open").groupBy("k").agg(F.collect_list(F.struct("gram", "lo", "hi")).alias("asked"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("asked")[i].as_py()
                k, text = batch.column("_k")[i].as_py(), (batch.column("_text")[i].as_py() or "").encode()
                got = cut(text, [(r["lo"], r["hi"]) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array([r["gram"] for r in rows]), pa.array([k] * len(rows)), pa.array([r["lo"] for r in rows]), pa.array(got, type=pa.binary())], names=["gram", "k", "lo", "piece"])

    return docs.select("_k", "_text").join(asked.withColumnRenamed("k", "_k"), "_k").mapInArrow(take, schema)


def by_load(made: DataFrame, target_bytes: int, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a task number, rows of grams too large for a task). Tasks hold about target_bytes of pieces."""
    total = made.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    tasks = 1 + total // target_bytes
    # written, so that its size is known: while it is small it is broadcast, and the pieces aren't shuffled by gram
    hot = materialise_few(made.groupBy("gram").count().where(F.col("count") > most_rows).select("gram"))
    return made.join(hot, "gram", "left_anti").withColumn("task", F.pmod(F.xxhash64("gram"), F.lit(tasks))), made.join(hot, "gram", "left_semi")


def ranges_of(marked: np.ndarray, k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, lo, hi) of the maximal runs of marked window starts."""
    k, at = k[marked], at[marked]
    if not len(k):
        return k, at, at
    order = np.lexsort((at, k))
    k, at = k[order], at[order]
    cut = np.flatnonzero((np.diff(k) != 0) | (np.diff(at) != 1))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(k) - 1]])
    return k[first], at[first], at[last]


def by_content(hot: DataFrame, width: int, size: int, all_of_them: bool) -> DataFrame:
    """(k, lo, hi) of repeated windows of the hot grams, window by window: hashes of 128 bits are counted (or their
    first place found) by aggregation before the shuffle, so that no group is gathered. width: bytes of a symbol."""
    import xxhash

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece, k, lo = batch.column("piece")[i].as_py(), batch.column("k")[i].as_py(), batch.column("lo")[i].as_py()
                n = len(piece) // width - size + 1
                w = [xxhash.xxh3_128_digest(piece[j * width : (j + size) * width]) for j in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(w, type=pa.binary()), pa.array([k] * n), pa.array(range(lo, lo + n), type=pa.int64())], names=["w", "k", "p"])

    each = hot.select("piece", "k", "lo").mapInArrow(explode, "w binary, k long, p long")
    known = each.groupBy("w").agg(F.min(F.struct("k", "p")).alias("f"), F.count("*").alias("n")).where(F.col("n") > 1).select("w", "f")
    repeated = each.join(known, "w")
    if not all_of_them:
        repeated = repeated.where(F.struct("k", "p") > F.col("f"))
    return repeated.select("k", F.col("p").alias("lo"), F.col("p").alias("hi"))


def per_text(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs with `_gone`: the ranges (lo, hi) of window starts to remove in each text, or null."""
    gone = ranges.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("_gone"))
    return docs.join(gone.withColumnRenamed("k", "_k"), "_k", "left")


def covered(n: int, ranges: list[dict] | None, size: int) -> np.ndarray | None:
    """Which of n symbols a marked window covers; None: no one."""
    if not ranges:
        return None
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, np.array([r["lo"] for r in ranges]), 1)
    np.add.at(step, np.array([r["hi"] for r in ranges]) + size, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0
