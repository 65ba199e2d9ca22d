"""N-best segmentation of whole texts over a sentencepiece vocabulary, and decoding.

No piece crosses a space that follows another character, nor a line feed, so the lattice of a text is a chain of
unit lattices. Forward Viterbi scores are exact heuristics for an A* search that runs backward from the end. Under an exact
heuristic the edge that loses nothing is always at the head of the queue, so the first hypothesis follows these edges without
one; the further ones leave the queue in order of their whole score. A hypothesis of rank n changes at most n - 1 units, and only
such as have the cheapest changes: the search of a text's N best is thus run on those units alone and put together over the
chain. Unit results are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush, nsmallest
from itertools import chain
from math import inf
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from archloom.llm.common import only

MARK = "▁"
UNIT = re.compile("\n| *[^ \n]+| +")
#: What a character outside the vocabulary costs beyond the worst piece, as in the library's lattices.
UNKNOWN_PENALTY = 10


class Segmented(NamedTuple):
    score: float
    #: piece ids as little-endian 32-bit integers
    packed: bytes
    #: what the second best loses against the best; infinite if there is none
    loss: float

    @property
    def ids(self) -> tuple[int, ...]:
        return tuple(np.frombuffer(self.packed, dtype="<i4").tolist())


class Vocabulary(dict):
    """Unit to Segmented, worked out on demand. Holds two generations of a bounded number of units: when the young
    one is full it becomes the old one, and units found there come back, so frequent ones stay."""

    def __init__(self, model_file: str, n_best: int = 4, most_units: int = 200_000) -> None:
        import sentencepiece

        super().__init__()
        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n_best, self.most_units = n_best, most_units
        size = p.get_piece_size()
        plain = [i for i in range(size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.pieces = {p.id_to_piece(i).replace(MARK, " "): (i, p.get_score(i)) for i in plain}
        if any(re.search("[^ ] |\n", x) for x in self.pieces):
            raise ValueError("this vocabulary has pieces across spaces or line feeds")
        #: every beginning of a piece: its id and score if it is one, else an empty tuple
        self.trie: dict[str, tuple] = {x[:k]: () for x in self.pieces for k in range(1, len(x))} | self.pieces
        #: the same for every end of a piece
        packed = {x: (i.to_bytes(4, "little"), score) for x, (i, score) in self.pieces.items()}
        self.ends: dict[str, tuple] = {x[k:]: () for x in self.pieces for k in range(1, len(x))} | packed
        self.old: dict[str, Segmented] = {}
        self.rivals: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.spelled = [b""] * size
        for text, (i, _) in self.pieces.items():
            self.spelled[i] = text.encode()
        for b, i in enumerate(self.bytes):
            self.spelled[i] = bytes([b])

    def __missing__(self, unit: str) -> Segmented:
        self.prepare([unit])
        return self[unit]

    def best(self, unit: str) -> Segmented:
        return next(self.viterbi([unit]))

    def prepare(self, units: Iterable[str]) -> None:
        """Works out what isn't held yet, all together."""
        if len(self) >= self.most_units:
            self.old = dict(self)
            self.clear()
        new = {u for u in set(units) if u not in self}
        for unit in new.intersection(self.old):
            self[unit] = self.old[unit]
        new = sorted(new.difference(self.old))
        self.update(zip(new, self.viterbi(new), strict=True))

    def viterbi(self, units: list[str]) -> Iterator[Segmented]:
        """Forward Viterbi over sorted units; a unit goes on from the places it shares with the one before.

        The second best leaves the best path, read from the end, at one of its places; so its loss is the least gap
        between the two best ways into a place on that path. Of equal ways the longer piece is taken.
        """
        get, unknown = self.ends.get, self.unknown
        first, ways = [0.0], [(inf, 0, b"")]  # by place: best score; its gap to the second, where it starts, its ids
        before = ""
        for unit in units:
            n, same = len(unit), 0
            for x, y in zip(before, unit):
                if x != y:
                    break
                same += 1
            del first[same + 1 :], ways[same + 1 :]
            before = unit
            for end in range(same + 1, n + 1):
                at = end - 1
                found = get(unit[at])
                second = -inf
                if found:
                    own, best = found
                    best += first[at]
                else:
                    own, best = b"".join(i.to_bytes(4, "little") for i in self.spell(unit[at])), first[at] + unknown
                if found is not None:
                    start = at - 1
                    while start >= 0:
                        found = get(unit[start:end])
                        if found:
                            score = first[start] + found[1]
                            if score >= best:
                                best, second, at, own = score, best, start, found[0]
                            elif score > second:
                                second = score
                        elif found is None:
                            break
                        start -= 1
                first.append(best)
                ways.append((best - second, at, own))
            path, at, loss = [], n, inf
            while at:
                gap, at, own = ways[at]
                if gap < loss:
                    loss = gap
                path.append(own)
            path.reverse()
            yield Segmented(first[n], b"".join(path), loss)

    def spell(self, sign: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in sign.encode())

    def edges(self, unit: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """By end: (start, ids, score) of each piece, longest first; a character without a piece goes by its bytes."""
        out: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(len(unit) + 1)]
        for start in range(len(unit)):
            for end in range(start + 1, len(unit) + 1):
                piece = self.trie.get(unit[start:end])
                if piece:
                    out[end].append((start, piece[:1], piece[1]))
                elif piece is None:
                    break
            if unit[start] not in self.pieces:
                out[start + 1].append((start, self.spell(unit[start]), self.unknown))
        return out

    def search(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """The n_best segmentations, by A* from the end under the forward scores.

        Of equal scores, that with the longer last differing piece comes first.
        """
        edges = self.edges(unit)
        forward = [0.0] * len(edges)
        for end in range(1, len(edges)):
            forward[end] = max((forward[start] + score for start, _, score in edges[end]), default=-inf)
        found: list[tuple[float, tuple[int, ...]]] = []
        # (-(forward + behind), -serial, place, score behind, pieces behind as a linked list)
        queue: list = [(-forward[-1], 0, len(unit), 0.0, None)]
        serial = 0
        while queue and len(found) < self.n_best:
            cost, _, at, behind, path = heappop(queue)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((-cost, tuple(ids)))
                continue
            for start, own, score in reversed(edges[at]):  # the longest is pushed last and leaves first
                serial -= 1
                total = behind + score
                heappush(queue, (-(forward[start] + total), serial, start, total, (own, path)))
            if len(queue) > 8 * self.n_best:  # each entry leads to a hypothesis of just its score: no more can matter
                queue = nsmallest(self.n_best, queue)
        return found

    def others(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """(loss against the best, ids) of the second to n_best segmentation of a unit."""
        if unit not in self.rivals:
            if len(self.rivals) >= self.most_units:
                self.rivals.clear()
            (best, _), *rest = self.search(unit)
            self.rivals[unit] = [(best - s, ids) for s, ids in rest]
        return self.rivals[unit]

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + (text.replace(MARK, " ") if MARK in text else text)) if text else []

    def encode_all(self, texts: list[str]) -> Iterator[tuple[float, bytes, list[tuple[float, list[tuple[int, tuple[int, ...]]]]]]]:
        """For each text the best score and packed ids, and the further hypotheses as (loss, [(unit number, other ids)])."""
        split = [self.units(text) for text in texts]
        self.prepare(chain.from_iterable(split))
        yield from map(self.encode_units, split)
        for unit in {u for units in split for u in units if len(u) > 64}:  # rare: none is kept
            del self[unit]

    def encode_units(self, units: list[str]):
        if not units:
            return 0.0, b"", []
        scores, packed, losses = zip(*map(self.__getitem__, units), strict=True)
        # the n_best - 1 cheapest single changes; a hypothesis that changes any other unit loses to all of these
        lost, some = np.array(losses), min(self.n_best - 1, len(units))
        near = np.flatnonzero(lost <= np.partition(lost, some - 1)[some - 1])
        places = [int(i) for i in near[np.argsort(lost[near], kind="stable")][:some] if lost[i] < inf]
        mixes: list[tuple[float, list[tuple[int, tuple[int, ...]]]]] = [(0.0, [])]
        for i in sorted(places):
            mixes = nsmallest(self.n_best, [(c + loss, e + own) for c, e in mixes for loss, own in ((0.0, []), *((x, [(i, o)]) for x, o in self.others(units[i])))])
        return sum(scores), b"".join(packed), mixes[1:]

    def encode(self, text: str):
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a segmentation; bytes that form no character become U+FFFD."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode(errors="replace")[1:]


def sliced(batches: Iterator[pa.RecordBatch], text_column: str, rows: int = 1024, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        sizes = [n or 0 for n in pc.binary_length(batch.column(text_column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= rows or total + n > limit):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if sizes:
            yield batch.slice(start)


def encode_texts(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", n_best: int = 4, with_ids: bool = True) -> DataFrame:
    """The best segmentation of every whole text, its n_best - 1 rivals, and whether decoding gives the text back.

    A null text counts as empty: no pieces, score 0, no rivals, round trip true. U+2581 stands for a space and is read as one.
    Repeated rows give a row each; an empty table gives an empty result; further columns are ignored.
    Columns: id, n_pieces, score, ids_sha256 (of the ids as little-endian 32-bit integers), rivals
    (array of (loss, edits), edits being unit:id id ...;...), round_trip and, with_ids, ids.
    """
    kind = docs.schema[id_column].dataType
    rival = T.StructType([T.StructField("loss", T.DoubleType()), T.StructField("edits", T.StringType())])
    fields = [(id_column, kind), ("n_pieces", T.LongType()), ("score", T.DoubleType()), ("ids_sha256", T.StringType()), ("rivals", T.ArrayType(rival)), ("round_trip", T.BooleanType()), ("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(*f) for f in (fields if with_ids else fields[:-1])])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model_file, n_best)
        rivals_type = pa.list_(pa.struct([("loss", pa.float64()), ("edits", pa.string())]))
        for batch in sliced(batches, text_column):
            out: list[list] = [[] for _ in fields[1:]]
            texts = [t or "" for t in batch.column(text_column).to_pylist()]
            for text, (score, packed, mixes) in zip(texts, vocabulary.encode_all(texts), strict=True):
                ids = np.frombuffer(packed, dtype="<i4")
                rivals = [{"loss": loss, "edits": ";".join(f"{i}:{' '.join(map(str, own))}" for i, own in edits)} for loss, edits in mixes]
                back = vocabulary.decode(ids.tolist()) == text.replace(MARK, " ")
                for column, x in zip(out, (len(ids), score, hashlib.sha256(packed).hexdigest(), rivals, back, ids if with_ids else None), strict=True):
                    column.append(x)
            types = [pa.int64(), pa.float64(), pa.string(), rivals_type, pa.bool_(), pa.list_(pa.int32())]
            arrays = [pa.array(c, type=t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *(arrays if with_ids else arrays[:-1])], names=[f.name for f in schema])

    return only(docs, id_column, text_column).mapInArrow(encode, schema)


def decode_ids(encoded: DataFrame, model_file: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """Adds the text of each id array (null: null) to the columns of `encoded`; a column of that name gives way."""
    encoded = encoded.drop(text_column)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_column, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model_file)
        for batch in batches:
            texts = [None if x.as_py() is None else vocabulary.decode(x.as_py()) for x in batch.column(ids_column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, text_column])

    return encoded.mapInArrow(decode, schema)
