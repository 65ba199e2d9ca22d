import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import brute

from archloom.llm import queries
from archloom.llm import windows
from archloom.llm.hashing import TABLE, word_ids, word_spans
from archloom.llm.substring_dedup import deep_leaves, prefix_groups, substring_dedup, subtree
from archloom.llm.suffix_dedup import suffix_dedup, suffix_order
from archloom.llm.windows import Seen, Stretches, stretches, text_stretches


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def suffixes(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in df.collect()}


def substrings(df):
    return {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in df.collect()}


def test_suffix_order():
    r = random.Random(2)
    for n in (*range(1, 30), 100, 301, 500):
        for letters in (1, 2, 4):
            t = np.array([r.randint(1, letters) for _ in range(n)])
            got = suffix_order(t, n + 1).tolist()
            assert got == sorted(range(n), key=lambda i: t[i:].tolist())
            cut = [t[i : i + 5].tolist() for i in suffix_order(t, 5)]
            assert cut == sorted(cut)
    wide = np.array([r.randint(1, 1 << 40) for _ in range(200)] * 2)
    assert suffix_order(wide, 500).tolist() == sorted(range(400), key=lambda i: wide[i:].tolist())


def test_stretches_hold_every_window_once_and_equal_windows_alike():
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(n)).encode() for n in (50, 0, 7, 300, 41, 40)]
    texts.append(texts[3][20:200])
    buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    s = stretches(TABLE[buffer], buffer, at[:-1], at[1:] - 1, 40, 8)
    seen, of = [], {}
    for t, lo, hi, g in zip(s.text.tolist(), s.lo.tolist(), s.hi.tolist(), s.gram.tolist(), strict=True):
        for j in range(lo, hi + 1):
            seen.append((t, j))
            assert of.setdefault(texts[t][j : j + 40], g) == g
    assert sorted(seen) == [(i, j) for i, t in enumerate(texts) for j in range(len(t) - 39)]


def test_a_long_text_in_segments():
    r = random.Random(9)
    text = np.frombuffer("".join(r.choice("abc") for _ in range(3000)).encode(), dtype=np.uint8)
    at, end = np.array([0]), np.array([len(text)])
    whole = stretches(TABLE[text], text, at, end, 40, 8)
    of = {j: g for lo, hi, g in zip(whole.lo, whole.hi, whole.gram, strict=True) for j in range(lo, hi + 1)}
    for segment in (50, 333, 1499):
        s = text_stretches(lambda a, b: (TABLE[text[a:b]], text[a:b]), at, end, 40, 8, segment)
        got = {j: g for lo, hi, g in zip(s.lo, s.hi, s.gram, strict=True) for j in range(lo, hi + 1)}
        assert got == of and sum(s.hi - s.lo + 1) == len(of)


def test_very_long_texts(spark):
    """Five million bytes that hold two copies of a passage and share one with a short text."""
    r = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"{r.randrange(10**9)}" for _ in range(250_000)) + " " + passage + " " + " ".join(f"{r.randrange(10**9)}" for _ in range(250_000)) + " " + passage
    docs = spark.createDataFrame([(1, long), (2, passage)], "doc_id long, text string")
    n = len(passage)
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup(docs).collect()}
    assert got == {1: (n + 1, 1), 2: (n, 1)}
    assert {x.doc_id: x.n_removed for x in substring_dedup(docs).collect()} == {1: 120, 2: 60}


def test_subtrees_find_the_repeats():
    r = random.Random(3)
    words = np.array([r.randint(0, 2) for _ in range(400)])
    at = np.arange(390)
    for most in (1, 5, 1000):
        found = set()
        for group, prefix in prefix_groups(words, at, 10, most):
            found |= set(deep_leaves(*subtree(words, group, prefix, 10), 10).tolist())
        w = [tuple(words[i : i + 10]) for i in at]
        assert found == {i for i in at.tolist() if w.count(w[i]) > 1}


def test_word_ids_are_the_words():
    words = ["", "a", "b", "a\0", "x" * 8, "x" * 15, "x" * 15 + "\0", "x" * 16, "x" * 17, "é" * 7, "é" * 8, *doubled()]
    text = np.frombuffer(" ".join([*words, *words]).encode(), dtype=np.uint8)
    ids = list(map(tuple, word_ids(text, *word_spans(text)).tolist()))
    half = len(words) - 1
    assert ids[:half] == ids[half:] and len(set(ids)) == half


def doubled():
    """Two words of 1,024 letters that are equal under any polynomial modulo 2^64."""
    x, y = "a", "b"
    while len(x) < 1024:
        x, y = x + y, y + x
    return x, y


def test_structured_words_are_told_apart(spark):
    x, y = doubled()
    tail = " " + " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, x + tail), (2, y + tail), (3, " ".join([x, y, y, x] * 20)), (4, " ".join([y, x, x, y] * 20))], "doc_id long, text string")
    assert substrings(substring_dedup(docs)) == brute.substring_deduped([tuple(r) for r in docs.collect()])
    assert substring_dedup(docs.where("doc_id < 3")).agg({"n_removed": "sum"}).first()[0] == 0


def test_clashing_grams_are_settled_by_content(spark, tangled, monkeypatch):
    """With grams that say nothing all stretches meet; what is equal is decided by content alone."""
    monkeypatch.setattr(windows, "mix", lambda x: x & windows.U(3))
    docs = spark.createDataFrame(tangled[:60], "doc_id long, text string")
    assert suffixes(suffix_dedup(docs)) == brute.suffix_deduped(tangled[:60])
    assert substrings(substring_dedup(docs)) == brute.substring_deduped(tangled[:60])


def test_given_documents(spark):
    for folder in (brute.SF, "/root/testdata/sf0.01"):
        docs = brute.rows_of(spark.read.parquet(f"{folder}/documents.parquet"))
        assert by_id(queries.op8_suffix_dedup(spark, folder)) == brute.suffix_deduped(docs)
        assert by_id(queries.op10_substring_dedup(spark, folder)) == brute.substring_deduped(docs)


@pytest.fixture(scope="module")
def tangled():
    """Passages of many lengths in many contexts, periodic texts, and copies."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 6)))
    passages = [[word() for _ in range(n)] for n in (20, 34, 35, 36, 50, 90)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(r.randint(0, 5)):
            text += [word() for _ in range(r.randint(0, 30))]
            p = r.choice(passages)
            a = r.randint(0, 10)
            text += p[a : len(p) - r.randint(0, 10)] if r.random() < 0.5 else p
        rows.append((i * 3, " ".join(text)))
    rows += [(1000, "ab " * 200), (1001, "x" * 450), (1002, "ab " * 180), (1003, rows[5][1]), (1004, None), (1005, ""), (1006, "é" * 99), (1007, "é" * 99)]
    r.shuffle(rows)
    return rows


def test_tangled_passages(spark, tangled):
    docs = spark.createDataFrame(tangled, "doc_id long, text string").repartition(5)
    one, all_ = brute.suffix_deduped(tangled), brute.substring_deduped(tangled)
    for more in ({}, {"most_rows": 3}, {"task_bytes": 2000}):
        assert suffixes(suffix_dedup(docs, **more)) == one
        assert substrings(substring_dedup(docs, **more)) == all_


def test_many_copies_in_any_order(spark):
    """Copies far beyond two a task, in falling order of ids and over several slices."""
    r = random.Random(1)
    line = " ".join(f"common{i}" for i in range(45))
    rows = [(i, f"own{i} " * r.randint(1, 40) + line + f" end{i}" * r.randint(1, 40)) for i in range(300)] + [(1000 + i, line + " " + line) for i in range(50)]
    for order in (sorted(rows, reverse=True), sorted(rows), r.sample(rows, len(rows))):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(2)
        assert suffixes(suffix_dedup(docs)) == brute.suffix_deduped(rows)
        assert substrings(substring_dedup(docs)) == brute.substring_deduped(rows)


def test_seen_sends_two_and_all_that_come_earlier():
    seen, n = Seen(bits=4), 6
    alike = lambda k, lo: (Stretches(np.arange(len(k)), np.array(lo), np.array(lo), np.full(len(k), 7), np.full(len(k), 9), np.full(len(k), 5)), np.array(k))
    assert seen.extra(*alike([5] * n, range(n))).tolist() == [False, False, True, True, True, True]
    assert seen.extra(*alike([6, 4, 5], [0, 0, 9])).tolist() == [True, False, True]
    assert seen.extra(*alike([], [])).tolist() == []


def test_odd_rows(spark):
    docs = brute.with_clashes(brute.odd(spark), "k", "lo", "gram", "_k", "_gone")
    assert suffixes(suffix_dedup(docs)) == brute.suffix_deduped(brute.rows_of(docs))
    assert substrings(substring_dedup(docs)) == brute.substring_deduped(brute.rows_of(docs))
    assert suffix_dedup(brute.empty(spark)).count() == 0 and substring_dedup(brute.empty(spark)).count() == 0


def test_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (2, "short"), (2, "short"), (3, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup(docs).collect())
    n = len(long)
    assert got == [(0, 0), (1, n), (1, n), (2, 0), (2, 0), (3, n)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup(docs).collect()) == [(0, 60), (1, 60), (1, 60), (2, 0), (2, 0), (3, 60)]
    text_ids = docs.selectExpr("coalesce(cast(doc_id as string), 'x') as doc_id", "text")
    assert sum(r.n_removed for r in suffix_dedup(text_ids).collect()) == 3 * n
