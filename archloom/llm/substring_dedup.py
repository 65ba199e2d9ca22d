"""Removal of all copies of long word sequences, by prefix-partitioned suffix trees.

1. Texts are cut into stretches of windows by content-chosen anchors (windows.py); equal stretches repeat as a whole.
   Words are compared by themselves (128 bits, exact up to 15 bytes), stretches by a salted 128-bit digest of their words.
2. Where one anchor has unequal stretches, their suffixes are split by prefixes of variable length: a group too large for
   memory gets a longer prefix, a suffix alone in its group is unique and done. Each group becomes a subtree, held
   as its leaves in order with the depth of the node between neighbours. The deep internal nodes, at least a window
   below the root, are the repeats; every window under one is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import byte_rows, materialise_few, only
from archloom.llm.hashing import joined_texts, scrambled, words_in
from archloom.llm.windows import MADE, Seen, by_content, by_load, covered, keyed, met, per_text, pieces, ranges_of, rows_of, text_stretches

PIECE = "gram long, k long, lo long, piece binary"
RANGE = "k long, lo long, hi long"


def prefix_groups(words: np.ndarray, at: np.ndarray, size: int, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(suffix starts, prefix length) of the groups of at least two suffixes that share a prefix.

    Prefixes start at one word and double, but only for groups of more than `most` suffixes.
    """
    waiting = [(at, 0)]
    while waiting:
        group, length = waiting.pop()
        if len(group) < 2:
            continue
        if length and (len(group) <= most or length >= size):
            yield group, length
            continue
        longer = min(size, max(1, 2 * length))
        key = np.zeros(len(group), dtype=np.int64)
        for j in range(length, longer):  # suffixes of a group agree before
            key = np.unique(key * (int(words.max()) + 1) + words[group + j], return_inverse=True)[1]
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
        for run in np.flatnonzero(np.diff(first) > 1).tolist():
            waiting.append((group[order[first[run] : first[run + 1]]], longer))


def subtree(words: np.ndarray, group: np.ndarray, prefix: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of the suffix tree of a group, in order, and the depth (up to `size`) of the node that joins each to
    the leaf before; the first has depth 0."""
    rows = words[group[:, None] + np.arange(prefix, size)].astype(">u4") if prefix < size else np.zeros((len(group), 1), dtype=">u4")
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"V{rows.shape[1] * 4}").ravel(), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    depth = np.where(differ.any(axis=1), prefix + differ.argmax(axis=1), size)
    return group[order], np.concatenate([[0], depth])


def deep_leaves(leaves: np.ndarray, depth: np.ndarray, size: int) -> np.ndarray:
    """Leaves under an internal node at least `size` below the root: neighbours joined so deep."""
    near = depth >= size
    near[:-1] |= depth[1:] >= size
    return leaves[near]


def numbered(words: np.ndarray) -> np.ndarray:
    """A number for each distinct word id."""
    order = np.lexsort((words[:, 1], words[:, 0]))
    fresh = np.zeros(len(order), dtype=np.int64)
    fresh[1:] = (np.diff(words[order], axis=0) != 0).any(axis=1)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(fresh)
    return out


def all_copies(part: pd.DataFrame, size: int, most: int = 4096) -> pd.DataFrame:
    """Ranges of window starts whose word sequence stands twice or more in the pieces."""
    held = [np.frombuffer(p, dtype="<u8").reshape(-1, 2) for p in part["piece"]]
    sizes = np.array([len(p) for p in held])
    names = numbered(np.concatenate(held))
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(held)), sizes)
    offset = np.arange(len(names)) - start[owner]
    valid = np.flatnonzero(offset + size <= sizes[owner])
    twice = np.zeros(len(names), dtype=bool)
    for group, prefix in prefix_groups(names, valid, size, most):
        twice[deep_leaves(*subtree(names, group, prefix, size), size)] = True
    at = np.flatnonzero(twice)
    k, p = part["k"].to_numpy()[owner[at]], part["lo"].to_numpy()[owner[at]] + offset[at]
    return pd.DataFrame(dict(zip(("k", "lo", "hi"), ranges_of(np.ones(len(at), dtype=bool), k, p), strict=True)))


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 35, gram: int = 8, task_bytes: int = 6 << 20, most_rows: int = 20_000) -> DataFrame:
    """Removes every word that a window of `size` words covers whose sequence also starts anywhere else.

    All copies go, the first included; windows are judged on the input and never cross texts. Words are runs without
    ASCII white space, unchanged; what stays is joined by single spaces. Null texts have no words; repeated
    rows are copies of each other; an empty table gives an empty result; further columns are ignored.

    Grams with more than `most_rows` unequal stretches are settled window by window instead, with the same result.
    Columns: id, n_words, n_removed, text.
    """
    docs = only(docs, id_column, text_column)
    kind = docs.schema[id_column].dataType
    rows, plain = keyed(docs, id_column, text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for ids, texts in byte_rows(batches, "_k", "_text"):
            buffer, at = joined_texts(texts)
            start, words = words_in(buffer)
            symbols, own = scrambled(words), np.searchsorted(start, at)
            yield rows_of(text_stretches(lambda a, b: (symbols[a:b], words[a:b]), own[:-1], own[1:], size, gram), ids, seen)

    def contents(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        words = words_in(np.frombuffer(text, dtype=np.uint8))[1]
        return [words[lo : hi + size].tobytes() for lo, hi in spans]

    made = rows.select("_k", "_text").mapInArrow(cut, MADE)
    found = materialise_few(met(made))
    open_ = materialise_few(pieces(found, rows, contents, PIECE))
    dealt, hot = by_load(open_, task_bytes, most_rows)
    settled = dealt.groupBy("task").applyInPandas(lambda part: all_copies(part, size), RANGE)
    ranges = found.where(~F.col("open")).select("k", "lo", "hi").unionByName(settled).unionByName(by_content(hot, 16, size, True))
    columns = ["_k"] if plain else ["_k", "_id"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, gone in zip(batch.column("_text").cast(pa.large_binary()), batch.column("_gone"), strict=True):
                words = (text.as_py() or b"").split()
                mask = covered(len(words), gone.as_py(), size)
                kept = words if mask is None else [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
                for column, x in zip(out, (len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                    column.append(x)
            arrays = [pa.array(out[0], type=pa.int64()), pa.array(out[1], type=pa.int64()), pa.array(out[2], type=pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *arrays], names=[*columns, "n_words", "n_removed", "text"])

    schema = f"_k long, {'' if plain else f'_id {kind.simpleString()}, '}n_words long, n_removed long, text string"
    done = per_text(rows, ranges).select(*columns, "_text", "_gone").mapInArrow(remove, schema)
    return done.select((F.col("_k").cast(kind) if plain else F.col("_id")).alias(id_column), "n_words", "n_removed", "text")
