"""Removal of later copies of long byte strings, by suffix sorting over a difference cover.

1. Texts are cut into stretches of windows by content-chosen anchors (windows.py). The anchors are a difference cover
   that the content draws: equal windows have a sampled position at the same offset, as a fixed cover mod v would give,
   but at 3 % of all positions instead of two thirds. Equal stretches fall together by their names (salted 128-bit digests of their bytes); later ones go.
2. Where one anchor has unequal stretches, these are suffix-sorted: triples at positions not divisible by 3 are sorted
   and named, the names are sorted by recursion, the remaining suffixes are merged in, and neighbours in the order are
   compared over the full length. Of equal strings the first in the corpus stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import byte_rows, materialise_few, only
from archloom.llm.hashing import TABLE, joined_texts
from archloom.llm.windows import MADE, Seen, by_content, by_load, covered, keyed, met, per_text, pieces, ranges_of, rows_of, text_stretches

PIECE = "gram long, k long, lo long, piece binary"
RANGE = "k long, lo long, hi long"


def compact(names: np.ndarray) -> np.ndarray:
    """Order-preserving names from 1."""
    return np.unique(names, return_inverse=True)[1].astype(np.int64) + 1


def suffix_order(text: np.ndarray, need: int) -> np.ndarray:
    """Starts of the suffixes of `text` (positive integers) sorted by their first `need` symbols at least.

    Sampled are the positions not divisible by 3. Names cover three times as much with each recursion, which ends when all
    names differ or `need` is reached; suffixes that agree so far stand together.
    """
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i : i + need].tolist()), dtype=np.int64)
    bits = int(text.max()).bit_length()
    if 3 * bits > 63:
        text = compact(text)
        bits = int(text.max()).bit_length()
    t = np.zeros(n + 4, dtype=np.int64)
    t[:n] = text
    extra = n % 3 == 1  # a sampled end mark keeps the two halves of the recursion apart
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    pairs = (t[:-1] << bits) | t[1:]
    if 3 * bits > 63:
        pairs = compact(pairs)
    triple = (pairs[sample] << bits) | t[sample + 2]
    order = np.argsort(triple, kind="stable")
    fresh = np.ones(len(order), dtype=np.int64)
    fresh[1:] = np.diff(triple[order]) != 0
    names = np.cumsum(fresh)
    if names[-1] == len(sample) or need <= 3:
        sorted_sample = sample[order]
    else:
        lower = np.empty(len(sample), dtype=np.int64)
        lower[order] = names
        sorted_sample = sample[suffix_order(lower, -(-need // 3))]
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    kept = sorted_sample[sorted_sample < n]
    wide = int(len(sample) + 1).bit_length()
    # the remaining suffixes, by their first symbol and the rank behind it
    rest = np.arange(0, n, 3)
    head = (t[rest] << wide) | rank[rest + 1]
    o = np.argsort(head, kind="stable")
    rest, head = rest[o], head[o]
    # merge: how many sampled suffixes of either kind stand before each
    s1, s2 = kept[kept % 3 == 1], kept[kept % 3 == 2]
    before = np.searchsorted((t[s1] << wide) | rank[s1 + 1], head)
    if 2 * bits + wide > 63:
        pairs = compact(pairs)
    key = lambda i: (pairs[i] << wide) | rank[i + 2]
    before += np.searchsorted(key(s2), key(rest))
    out = np.empty(n, dtype=np.int64)
    # among suffixes that agree for `need` symbols the counts may step back
    place = np.maximum.accumulate(before) + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[free] = kept
    return out


def equal_neighbours(buffer: np.ndarray, at: np.ndarray, size: int, block: int = 1 << 15) -> np.ndarray:
    """Whether each window of `size` symbols equals the one before it in `at`; the first never does."""
    out = np.zeros(len(at), dtype=bool)
    offsets = np.arange(size)
    for i in range(1, len(at), block):
        j = min(len(at), i + block)
        rows = buffer[at[i - 1 : j, None] + offsets]
        out[i:j] = (rows[1:] == rows[:-1]).all(axis=1)
    return out


def later_copies(part: pd.DataFrame, size: int) -> pd.DataFrame:
    """Ranges of window starts whose string stands earlier in the pieces: smaller k, or same k and smaller place."""
    held = part["piece"].tolist()
    buffer = np.frombuffer(b"\0".join(held), dtype=np.uint8)
    sizes = np.array([len(p) for p in held])
    start = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)]).astype(np.int64)
    end_mark = np.cumsum(sizes + 1)[:-1] - 1
    text = buffer.astype(np.int64) + 2
    text[end_mark] = 1
    order = suffix_order(text, size)
    owner = np.repeat(np.arange(len(held)), sizes + 1)[: len(text)]
    offset = np.arange(len(text)) - start[owner]
    order = order[offset[order] + size <= sizes[owner[order]]]
    same = equal_neighbours(buffer, order, size)
    near = same.copy()
    near[:-1] |= same[1:]
    group = np.cumsum(~same)[near]
    at = order[near]
    k, p = part["k"].to_numpy()[owner[at]], part["lo"].to_numpy()[owner[at]] + offset[at]
    o = np.lexsort((p, k, group))
    later = np.zeros(len(o), dtype=bool)
    later[1:] = np.diff(group[o]) == 0
    return pd.DataFrame(dict(zip(("k", "lo", "hi"), ranges_of(later, k[o], p[o]), strict=True)))


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 100, gram: int = 32, task_bytes: int = 1 << 20, most_rows: int = 20_000) -> DataFrame:
    """Removes every byte that a string of `size` bytes covers which also starts earlier.

    Earlier is a smaller id, or the same text and a smaller start; strings are judged on the input and never cross texts.
    Texts are taken as UTF-8; a null text is empty. Rows of one id are ordered by their text's digest; of repeated
    rows the first stays. An empty table gives an empty result; further columns are ignored. What is left may
    end inside a character, so it is given as bytes.

    Grams with more than `most_rows` unequal stretches are settled window by window instead, with the same result.
    Columns: id, n_bytes, n_removed, n_spans, kept (binary).
    """
    docs = only(docs, id_column, text_column)
    kind = docs.schema[id_column].dataType
    rows, plain = keyed(docs, id_column, text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for ids, texts in byte_rows(batches, "_k", "_text"):
            buffer, at = joined_texts(texts)
            yield rows_of(text_stretches(lambda a, b: (TABLE[buffer[a:b]], buffer[a:b]), at[:-1], at[1:] - 1, size, gram), ids, seen)

    made = rows.select("_k", "_text").mapInArrow(cut, MADE)
    found = materialise_few(met(made))
    open_ = materialise_few(pieces(found, rows, lambda text, spans: [text[lo : hi + size] for lo, hi in spans], PIECE))
    dealt, hot = by_load(open_, task_bytes, most_rows)
    settled = dealt.groupBy("task").applyInPandas(lambda part: later_copies(part, size), RANGE)
    ranges = found.where("again").select("k", "lo", "hi").unionByName(settled).unionByName(by_content(hot, 1, size, False))
    columns = ["_k"] if plain else ["_k", "_id"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, gone in zip(batch.column("_text").cast(pa.large_binary()), batch.column("_gone"), strict=True):
                b = text.as_py() or b""
                mask = covered(len(b), gone.as_py(), size)
                n = spans = 0
                if mask is not None:
                    n, spans = int(mask.sum()), int((np.diff(mask.astype(np.int8)) == 1).sum() + mask[0])
                    b = np.frombuffer(b, dtype=np.uint8)[~mask].tobytes()
                for column, x in zip(out, (len(b) + n, n, spans, b), strict=True):
                    column.append(x)
            arrays = [pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *arrays], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = f"_k long, {'' if plain else f'_id {kind.simpleString()}, '}n_bytes long, n_removed long, n_spans long, kept binary"
    done = per_text(rows, ranges).select(*columns, "_text", "_gone").mapInArrow(remove, schema)
    return done.select((F.col("_k").cast(kind) if plain else F.col("_id")).alias(id_column), "n_bytes", "n_removed", "n_spans", "kept")
