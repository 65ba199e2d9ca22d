"""Token counts of whole texts by a compiled finite-state transducer.

The vocabulary is compiled into a deterministic transducer that reads characters and emits token counts, without the library.
It rests on a property of pair merging by rank: a sequence of pieces is what merging gives for a text exactly if each piece
merges to itself and each two neighbours merge to just those two. So the last piece of every beginning of a text is fixed by the
last pieces of shorter beginnings, and a state needs no more than

* the longest end of what was read that is a proper beginning of some piece,
* for each place in it the last piece of the text up to there, and
* how many tokens the text up to there has, against the text up to now.

A transition reads a character and says by how much the count changes; it may fall, where a longer piece takes the place
of several. States are compiled when first reached. No piece holds a space mark after another character, or a line feed, so the
transducer returns to its start there: these are synchronising transitions.
A chunk of text maps entry states to (state, count): up to its first synchronising place the map depends on the entry state,
beyond it is constant. Such maps compose associatively. Texts above `split_chars` are cut into chunks whose maps are made in
parallel, in any task, and composed in their order; states travel in a form that every worker reads alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import only

MARK = "▁"
SYNC = re.compile(f"(?<=[^{MARK}])(?={MARK})|\n")
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class State:
    """tail: the end of what was read that begins some piece; last, behind: for each place in it the last piece before
    (-1: the start) and the count up to there less the count up to now; steps: character to (next state, change of count)."""

    __slots__ = ("behind", "last", "steps", "tail")

    def __init__(self, tail: str, last: tuple[int, ...], behind: tuple[int, ...]) -> None:
        self.tail, self.last, self.behind = tail, last, behind
        self.steps: dict[str, tuple[State, int]] = {}

    def key(self) -> tuple[str, tuple[int, ...], tuple[int, ...]]:
        return self.tail, self.last, self.behind


class ChunkMap(NamedTuple):
    """head: what comes before the first synchronising place, or all (then tail is None); tokens: emitted from there on;
    tail: the state at the end."""

    head: str
    tokens: int
    tail: State | None


class Units(dict):
    """Unit to what its path from a state emits: a path of transitions held as one."""

    def __init__(self, transducer: "Transducer", start: State, own: int) -> None:
        super().__init__()
        self.transducer, self.start, self.own = transducer, start, own

    def __missing__(self, unit: str) -> int:
        n = self.own + self.transducer.run(self.start, unit)[1]
        if len(unit) <= 64:
            if len(self) >= self.transducer.most_units:
                self.clear()
            self[unit] = n
        return n


class Transducer:
    def __init__(self, model_file: str, most_units: int = 200_000, most_states: int = 400_000) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)  # read for its vocabulary alone
        self.most_units, self.most_states = most_units, most_states
        size = library.get_piece_size()
        plain = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.rank = {library.id_to_piece(i): library.get_score(i) for i in plain}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("this vocabulary doesn't synchronise at spaces and line feeds")
        self.number = {p: i for i, p in enumerate(self.rank)}
        self.spelled = list(self.rank)
        self.begins = {p[:k] for p in self.rank for k in range(1, len(p))}
        self.alone = {p for p in self.rank if self.merged(p) == [p]}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.start = State("", (-1,), (0,))
        self.states: dict[tuple, State] = {self.start.key(): self.start}
        space, n = self.step(self.start, MARK)
        self.spaced = Units(self, space, n)  # units after one space mark
        self.bare = Units(self, self.start, 0)  # after a line feed

    def merged(self, text: str) -> list[str]:
        """What merging makes of a text: always the two neighbours whose union ranks highest, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank > best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        known = self.pairs.get((a, b))
        if known is None:
            x, y = self.spelled[a], self.spelled[b]
            known = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return known

    def step(self, state: State, sign: str) -> tuple[State, int]:
        """The transition of a state under a character; compiled once."""
        if sign == MARK and not state.tail.endswith(MARK) and state is not self.start:
            made = self.step(self.start, sign)
        elif sign not in self.rank:  # spelled in bytes, which nothing merges with
            made = self.start, len(sign.encode())
        else:
            text = state.tail + sign
            for at in range(len(text)):
                piece = text[at:]
                if piece in self.alone:
                    last, own = state.last[at], self.number[piece]
                    if last < 0 or self.fits(last, own):
                        break
            else:
                raise AssertionError("a character of the vocabulary is always a piece")
            change = state.behind[at] + 1
            keep = next((i for i in range(len(text)) if text[i:] in self.begins), len(text))
            key = text[keep:], (*state.last[keep:], own), (*(n - change for n in state.behind[keep:]), 0)
            found = self.states.get(key)
            if found is None:
                found = self.states[key] = State(*key)
            made = found, change
        state.steps[sign] = made
        return made

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text and the tokens emitted on the way."""
        total = 0
        for sign in text:
            found = state.steps.get(sign) or self.step(state, sign)
            state = found[0]
            total += found[1]
        if len(self.states) > self.most_states:  # forget what can be compiled again
            self.states = {self.start.key(): self.start}
            for known in (self.start, self.spaced.start):
                known.steps.clear()
        return state, total

    def emitted(self, text: str) -> int:
        """Tokens of a text that is read from the start state; all units between synchronising places."""
        total, spaced, bare = 0, self.spaced, self.bare
        for number, line in enumerate(text.split("\n")):
            total += number > 0  # a line feed is one byte token
            if MARK + MARK not in line:
                first, *rest = line.split(MARK)
                total += bare[first] + sum(map(spaced.__getitem__, rest))
            else:
                for unit in RUNS.findall(line):
                    total += spaced[unit[1:]] if unit[0] == MARK else bare[unit]
        return total

    def chunk(self, text: str) -> ChunkMap:
        first = SYNC.search(text)
        if not first:
            return ChunkMap(text, 0, None)
        at = first.start()
        last = max(at, text.rfind("\n"), *(m.start() for m in SYNC.finditer(text, max(0, len(text) - 4096))), at)
        state, n = self.run(self.start, text[last:])
        return ChunkMap(text[:at], self.emitted(text[at:last]) + n, state)

    def apply(self, chunk: ChunkMap, state: State) -> tuple[State, int]:
        """The map of a chunk at one entry state."""
        end, n = self.run(state, chunk.head)
        return (end, n) if chunk.tail is None else (chunk.tail, n + chunk.tokens)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.tokens, b.tail)
        end, n = self.apply(b, a.tail)
        return ChunkMap(a.head, a.tokens + n, end)

    def prepared(self, text: str) -> str:
        """As the library prepares a text: a space mark before it, space marks for spaces."""
        return MARK + text.replace(" ", MARK) if text else ""

    def count(self, text: str) -> int:
        return self.emitted(self.prepared(text))

    def packed(self, state: State | None) -> str | None:
        return None if state is None else json.dumps([state.tail, state.last, state.behind])

    def unpacked(self, state: str | None) -> State | None:
        if state is None:
            return None
        tail, last, behind = json.loads(state)
        key = tail, tuple(last), tuple(behind)
        return self.states.setdefault(key, State(*key))


@lru_cache(maxsize=2)
def compiled(model_file: str) -> Transducer:
    """The transducer of a worker: what one task compiles serves the next."""
    return Transducer(model_file)


CHUNK = "digest binary, at long, head string, tokens long, tail string"


def token_counts(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 4096, split_chars: int = 1 << 22, chunk_chars: int = 1 << 18) -> DataFrame:
    """Tokens of every whole text as the sentencepiece model of `model_file` gives them, without added tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give a row each; an empty table gives an empty result; further
    columns are ignored. A very long text takes as much memory as itself: one above `split_chars` characters is cut and counted
    in chunks by many tasks, the others are counted by a map without shuffle.
    Columns: id, n_bytes, n_tokens, over_limit. Each worker compiles what its texts need and holds a bounded number of states.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    sized = only(docs, id_column, text_column).toDF("id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    is_long = F.coalesce(F.length("text") > split_chars, F.lit(False))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model_file)
        for batch in batches:
            n = [transducer.count(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, type=pa.int64())], names=["id", "n_bytes", "n_tokens"])

    short = sized.where(~is_long).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    long = sized.where(is_long).withColumn("digest", F.unhex(F.sha2("text", 256)))
    counted = composed(chunk_maps(long.select("digest", "text"), model_file, chunk_chars), model_file)
    joined = long.select("id", "n_bytes", "digest").join(counted, "digest").select("id", "n_bytes", "n_tokens")
    return short.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_column)


def chunk_maps(long: DataFrame, model_file: str, chunk_chars: int) -> DataFrame:
    """The map of each chunk of texts (digest, text), dealt over all tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("digest"), batch.column("text"), strict=True):
                whole = MARK + text.as_py().replace(" ", MARK)
                for at in range(0, len(whole), chunk_chars):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], type=pa.binary()), pa.array([at], type=pa.int64()), pa.array([whole[at : at + chunk_chars]])], names=["digest", "at", "chunk"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model_file)
        for batch in batches:
            maps = [transducer.chunk(c.as_py()) for c in batch.column("chunk")]
            tails = [transducer.packed(m.tail) for m in maps]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("at"), pa.array([m.head for m in maps]), pa.array([m.tokens for m in maps], type=pa.int64()), pa.array(tails, type=pa.string())], names=["digest", "at", "head", "tokens", "tail"])

    return long.mapInArrow(cut, "digest binary, at long, chunk string").repartition("digest", "at").mapInArrow(read, CHUNK)


def composed(maps: DataFrame, model_file: str) -> DataFrame:
    """(digest, n_tokens): the maps of each text composed in their order, from the start state on. One text's maps stream
    through one task, which holds one state; repeated texts bring each map again, which is passed over."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model_file)
        name, place, state, total = None, -1, transducer.start, 0
        out: list[tuple[bytes, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["digest"] != name:
                    if name is not None:
                        out.append((name, total))
                    name, place, state, total = row["digest"], -1, transducer.start, 0
                if row["at"] > place:
                    place = row["at"]
                    state, n = transducer.apply(ChunkMap(row["head"], row["tokens"], transducer.unpacked(row["tail"])), state)
                    total += n
        if name is not None:
            out.append((name, total))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], type=pa.binary()), pa.array([n for _, n in out], type=pa.int64())], names=["digest", "n_tokens"])

    return maps.repartition("digest").sortWithinPartitions("digest", "at").mapInArrow(fold, "digest binary, n_tokens long")
