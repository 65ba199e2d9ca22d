import random

import numpy as np
from tests.llm import brute
from tests.llm.test_repeats import doubled

from archloom.llm import queries
from archloom.llm.components import connected_components
from archloom.llm.near_dedup import NearRules, across, distinct, near_dedup, shared


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_near_dedup_equals_brute_force(spark):
    for folder in (brute.SF, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        assert by_id(queries.op7_near_dedup(spark, folder)) == brute.near_components(brute.rows_of(docs))


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + w if rng.random() < share else w for w in words]


def test_chains_and_large_groups(spark):
    """Versions that drift apart word by word, a large group of near copies, and a group just under the threshold."""
    rng = random.Random(4)
    rows, version = [], [f"w{rng.randrange(5000)}" for _ in range(300)]
    for i in range(40):
        rows.append((1000 - i, " ".join(version)))
        version[rng.randrange(300)] = f"new{i}"
    for share, n, first in ((0.004, 120, 2000), (0.02, 60, 4000)):
        root = [f"v{rng.randrange(9000)}" for _ in range(250)]
        rows += [(first + i, " ".join(edited(rng, root, share))) for i in range(n)]
    rows += [(1, None), (2, ""), (3, "few words"), (4, "Few WORDS"), (5, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_components(rows)
    assert by_id(near_dedup(brute.with_clashes(docs, "n", "key", "sig", "component"))) == want
    assert by_id(near_dedup(docs, rules=NearRules(block=16, set_block=16))) == want
    assert len({c for _, c, _ in want.values()}) > 5


def test_buckets_in_blocks_join_what_the_signatures_allow(spark):
    rows = [(7, i, [0 if i % 2 else -1] * 6, i) for i in range(50)] + [(8, 99, [0] * 6, 99)]
    made = spark.createDataFrame(rows, "key long, rep long, sig array<long>, component long")
    members, sigs = made.drop("sig"), made.select("rep", "sig")
    for block in (8, 4096):
        edges = across(members, sigs, NearRules(block=block))
        got = {r.id: r.component for r in connected_components(edges).collect()}
        assert got == {i: i % 2 for i in range(50)}
        assert edges.count() <= 48 if block == 4096 else True


def test_odd_rows(spark):
    docs = brute.with_clashes(brute.odd(spark), "a", "b", "rep")
    assert by_id(near_dedup(docs)) == brute.near_components(brute.rows_of(docs))
    assert near_dedup(brute.empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (1, "other words"), (9, "other words"), (None, "a b c d e f")], "doc_id long, text string")
    got = [tuple(r) for r in near_dedup(twice).orderBy("doc_id", "n_shingles").collect()]
    assert got == [(None, 2, None, True), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (9, 1, 1, False)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 164)] + [(5, 163), (1, 2), (2, 2)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 5 for i in range(100, 165)}, 5: 5, 1: 1, 2: 1}
    assert connected_components(edges.limit(0)).count() == 0


def test_structured_words_are_told_apart(spark):
    x, y = doubled()
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x} {y} " * 30), (4, f"{y} {x} {x} " * 30)], "doc_id long, text string")
    assert by_id(near_dedup(docs)) == brute.near_components(brute.rows_of(docs))
    assert by_id(near_dedup(docs))[2] == (1, 2, True)


def test_sets_with_clashing_halves():
    half = lambda *x: np.array(x, dtype=np.uint64)
    x = distinct(half(5, 5, 5, 1, 2), half(1, 2, 1, 7, 8))
    assert sorted(zip(*(h.tolist() for h in x), strict=True)) == [(1, 7), (2, 8), (5, 1), (5, 2)]
    assert shared(x, distinct(half(5, 5, 1), half(2, 3, 7))) == 2
    assert shared(distinct(half(5, 1), half(1, 7)), distinct(half(5, 1), half(2, 7))) == 1


def test_repeated_ids_with_different_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = [(7, one), (7, two), (2, one + " end"), (9, two + " end"), (9, "alone"), (None, one), (3, "alone"), (4, "other")]
    got = sorted(map(repr, map(tuple, near_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect())))
    assert got == sorted(map(repr, [(7, 196, 2, False), (7, 196, 2, False), (2, 197, 2, True), (9, 197, 2, False), (9, 1, 2, False), (None, 196, None, True), (3, 1, 2, False), (4, 1, 4, True)]))
