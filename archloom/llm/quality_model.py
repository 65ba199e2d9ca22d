"""Quality classification without labels: overlapping heuristic labellers, a label model, a hashed linear scorer.

Each labeller votes good, bad or nothing on a document. Expectation-maximisation over the counts of vote patterns, which
are few however many documents there are, estimates each labeller's accuracy and so a posterior for each pattern.
The posteriors of a bounded sample train a linear scorer over hashed word features, which then scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import arrow_type, only, text_rows

#: Function words of the four languages of the corpus.
COMMON = frozenset(
    "the of and to in a is that for it with as was on are by this be at or an from not have which "
    "de la que el en y los del las un por con una para se su al "
    "le et les des du une est dans qui pour au pas sur ce "
    "der die und den das von zu mit sich auf ist im dem nicht ein eine".split()
)
MARKS = re.compile(r"[#*$%&|<>{}\\^~]")
SHAPES = (
    (re.compile(r"^[^\W\d_]+$"), 0),
    (re.compile(r"^[^\W\d_]+[.,;:!?…]$"), 1),
    (re.compile(r"^[\W_]+$"), 2),
    (re.compile(r"^\w+[\W_]{2,}$"), 3),
    (re.compile(r"\d"), 4),
)
LABELLERS = ("length", "word_length", "marks", "common_words", "line_ends", "repeated_lines", "repeated_words", "capitals")


class Voted(NamedTuple):
    votes: str
    features: tuple[np.ndarray, np.ndarray]


class Words(dict):
    """Word to its two feature numbers (the word itself, and its shape), worked out once."""

    def __init__(self, bits: int, most: int = 300_000) -> None:
        super().__init__()
        self.mask, self.most = (1 << bits) - 1, most

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= self.most:
            self.clear()
        shape = next((k for pattern, k in SHAPES if pattern.search(word)), 5)
        case = 0 if word.islower() else 1 if word.istitle() else 2 if word.isupper() and len(word) > 1 else 3
        length = min(7, len(word) // 3)
        own = xxhash.xxh3_64_intdigest(word.lower()) & self.mask
        out = self[word] = (own, xxhash.xxh3_64_intdigest(f"shape {shape} {case} {length}") & self.mask)
        return out


def votes(text: str, words: list[str]) -> str:
    """One sign a labeller: + good, - bad, 0 no opinion."""
    n = len(words)
    if not n:
        return "-" * len(LABELLERS)
    say = lambda good, bad: "+" if good else "-" if bad else "0"
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    marks = len(MARKS.findall(text)) / chars
    common = sum(w in COMMON for w in words) / n
    ends = sum(x.rstrip()[-1] in ".!?…\"'”»" for x in lines) / len(lines)
    repeated = 1 - len(set(lines)) / len(lines)
    distinct = len(set(words)) / min(n, 3000 + n // 10)
    capitals = sum(w.isupper() and len(w) > 1 for w in words) / n
    return "".join(
        (
            say(80 <= n <= 50_000, n < 5),
            say(3.2 <= chars / n <= 9, chars / n < 2.5 or chars / n > 14),
            say(marks < 0.01, marks > 0.06),
            say(common > 0.12, common < 0.03 and n >= 40),
            say(ends > 0.7, ends < 0.2),
            say(repeated < 0.05, repeated > 0.3),
            say(distinct > 0.3, distinct < 0.12),
            say(capitals < 0.05, capitals > 0.4),
        )
    )


def vectorised(words: list[str], cache: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse unit vector of square roots of counts."""
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    pairs = np.array([cache[w] for w in words], dtype=np.int64)
    counts = np.bincount(pairs[:, 0], minlength=size) + np.bincount(pairs[:, 1], minlength=size)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    return at.astype(np.int32), (value / np.sqrt((value**2).sum())).astype(np.float32)


def label_model(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], dict[str, float]]:
    """Posterior of good for each vote pattern, and each labeller's estimated accuracy where it votes.

    Labellers are taken as independent given the class. The start is the share of good votes, which also fixes
    which class is which.
    """
    if not patterns:
        return {}, {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    seen = np.array([["-0+".index(c) for c in k] for k in keys])
    post = np.clip(((seen == 2).sum(1) + 0.5) / ((seen == 2).sum(1) + (seen == 0).sum(1) + 1), 0.05, 0.95)
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        prior = np.clip(w.sum(1) / n.sum(), 0.02, 0.98)
        logs = np.log(prior)[:, None] * np.ones((1, len(keys)))
        share = np.zeros((seen.shape[1], 2, 3))
        for j in range(seen.shape[1]):
            for c in range(2):
                share[j, c] = (np.bincount(seen[:, j], weights=w[c], minlength=3) + 1) / (w[c].sum() + 3)
            logs += np.log(share[j][:, seen[:, j]])
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    prior = np.array([1 - (n * post).sum() / n.sum(), (n * post).sum() / n.sum()])
    accuracy = {name: float((prior[0] * share[j, 0, 0] + prior[1] * share[j, 1, 2]) / max(1e-9, (prior[:, None] * share[j][:, [0, 2]]).sum())) for j, name in enumerate(LABELLERS)}
    return dict(zip(keys, post.tolist(), strict=True)), accuracy


def linear_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, rounds: int = 150, rate: float = 0.5, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch AdaGrad; both classes get the same weight."""
    if not rows:
        return np.zeros(size), 0.0
    at, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())) * len(y)
    w, b, gw, gb = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[at] * value, minlength=len(y)) + b, -30, 30)))
        e = weight * (p - y) / len(y)
        g, h = np.bincount(at, weights=value * e[row], minlength=size) + l2 * w, e.sum()
        gw, gb = gw + g * g, gb + h * h
        w, b = w - rate * g / np.sqrt(gw), b - rate * h / np.sqrt(gb)
    return w, float(b)


def quality_model(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = 4096, bits: int = 15, least_score: float = 0.4) -> DataFrame:
    """A score for every whole text. Columns: id, votes, posterior, score, kept (score >= least_score).

    Votes, pattern counts and scores cover all documents; only the scorer's training rows are a sample: of the distinct
    (id, text) pairs the `sample_rows` with the least hashes, so that there are some however often rows are repeated. Null and
    empty texts get the worst votes; repeated rows are scored alike; a very long text is held whole by its task; an empty
    table gives an empty result; further columns are ignored.
    """
    docs = only(docs, id_column, text_column)
    kind, size, id_type = docs.schema[id_column].dataType.simpleString(), 1 << bits, arrow_type(docs, id_column)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_rows(batches, id_column, text_column):
            yield pa.RecordBatch.from_arrays([pa.array([votes(t, t.split()) for t in texts])], names=["votes"])

    counted = docs.mapInArrow(vote, "votes string").groupBy("votes").count()
    patterns = {r["votes"]: r["count"] for r in counted.collect()}  # at most 3 to the number of labellers
    posterior, _ = label_model(patterns)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, done = Words(bits), set()
        for draws, texts in text_rows(batches, "draw", "text"):
            fresh = {d: t for d, t in zip(draws, texts, strict=True) if d not in done}
            done.update(fresh)
            made = [(vectorised(t.split(), cache, size), posterior.get(votes(t, t.split()), 0.5)) for t in fresh.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(fresh), type=pa.int64()), pa.array([m[0][0] for m in made], type=pa.list_(pa.int32())), pa.array([m[0][1] for m in made], type=pa.list_(pa.float32())), pa.array([m[1] for m in made], type=pa.float64())],
                names=["draw", "at", "value", "y"],
            )

    # about twice the sample passes the first cut; if many rows are equal it may pass too few, and all are drawn from
    drawn = docs.select(F.xxhash64(F.lit("sample"), id_column, text_column).alias("draw"), F.col(text_column).alias("text"))
    total = sum(patterns.values())
    share = min(1.0, 2 * sample_rows / max(1, total))
    cut = min(2**63 - 1, int(-(2**63) + share * 2**64))
    least = [r.draw for r in drawn.select("draw").where(F.col("draw") <= cut).distinct().orderBy("draw").limit(sample_rows).collect()]
    if len(least) < sample_rows and share < 1:
        least = [r.draw for r in drawn.select("draw").distinct().orderBy("draw").limit(sample_rows).collect()]
    last = max(least, default=-(2**63))
    # a row a draw; each task featurises a draw once, and features of at most sample_rows draws come to the driver
    chosen = drawn.where(F.col("draw") <= last).mapInArrow(featured, "draw long, at array<int>, value array<float>, y double").dropDuplicates(["draw"])
    rows = [(np.array(r.at, dtype=np.int32), np.array(r.value, dtype=np.float32), r.y) for r in chosen.collect()]
    weights, bias = linear_scorer(sorted(rows, key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes())), size)
    weights = np.round(weights, 9)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words(bits)
        for ids, texts in text_rows(batches, id_column, text_column):
            out = []
            for t in texts:
                words = t.split()
                v = votes(t, words)
                at, value = vectorised(words, cache, size)
                p = 1 / (1 + np.exp(-np.clip(float(weights[at] @ value) + bias, -30, 30)))
                out.append((v, posterior.get(v, 0.5), float(p)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=id_type), *(pa.array(c) for c in zip(*out, strict=True))], names=[id_column, "votes", "posterior", "score"])

    scored = docs.mapInArrow(score, f"`{id_column}` {kind}, votes string, posterior double, score double")
    return scored.select(id_column, "votes", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), (F.col("score") >= least_score).alias("kept"))
