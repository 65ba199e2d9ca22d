import random

import public_tokenizers
import sentencepiece
from tests.llm import brute

from archloom.llm import queries
from archloom.llm.decontamination import decontaminate, without_contaminated
from archloom.llm.line_dedup import LineRuns, add_batch, line_dedup, without_lines
from archloom.llm.token_counts import Transducer, token_counts


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_decontamination_equals_brute_force(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").collect()]
    assert by_id(queries.op2_decontamination(spark, brute.SF)) == brute.decontaminated(brute.rows_of(docs), items)


def test_decontamination_of_odd_rows_in_blocks(spark):
    items = [(1, "One LINE"), (2, "x"), (3, None), (4, "same line here again same line here again same line"), (5, ""), (None, "word1"), (1, "One LINE")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = brute.with_clashes(brute.odd(spark), "n_words", "items", "ranges")
    want = brute.decontaminated(brute.rows_of(docs), items)
    for block_bytes in (1 << 20, 30):
        got = {d: (x[0], x[1], x[2], brute.sha(",".join(x[3])), x[4]) for d, x in by_id(decontaminate(docs, bench, block_bytes=block_bytes)).items()}
        assert got == want
    assert decontaminate(brute.empty(spark), bench).count() == 0
    assert all(not x[4] for x in by_id(decontaminate(docs, bench.limit(0))).values())


def test_decontamination_in_blocks_keeps_repeated_and_null_ids(spark):
    bench = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i}") for i in range(40)], "item_id long, text string")
    texts = ["x alpha1 beta1 gamma1", "alpha2 beta2 gamma2 y z alpha3 beta3 gamma3", "clean text", "clean text", "alpha4 beta4 gamma4", None, ""]
    docs = spark.createDataFrame(list(zip([1, 1, 1, 1, None, None, 7], texts, strict=True)), "doc_id long, text string")
    want = sorted(map(repr, [(1, 4, 3, 1, ["1"], True), (1, 8, 6, 2, ["2", "3"], True), (1, 2, 0, 0, [], False), (1, 2, 0, 0, [], False), (None, 3, 3, 1, ["4"], True), (None, 0, 0, 0, [], False), (7, 0, 0, 0, [], False)]))
    for block_bytes in (1 << 20, 200):
        assert sorted(repr(tuple(r)) for r in decontaminate(docs, bench, block_bytes=block_bytes).collect()) == want
    named = docs.withColumnsRenamed({"doc_id": "items", "text": "ranges"})
    assert sorted(repr(tuple(r)) for r in decontaminate(named, bench, "items", "ranges", block_bytes=200).toDF("i", "w", "h", "n", "k", "c").collect()) == want


def test_line_dedup_equals_brute_force(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    assert by_id(queries.op3_line_dedup(spark, brute.SF)) == brute.line_deduped(brute.rows_of(docs))


def test_line_dedup_by_broadcast_and_by_join(spark):
    rows = brute.ODD + [(100 + i, f"Common Line {i % 3} \n own {i}\n{'hot' if i % 2 else ' HOT '}\n", "en", "a", 1) for i in range(60)]
    docs = brute.with_clashes(spark.createDataFrame(rows, brute.SCHEMA), "n_lines", "h1", "_d", "_drop", "digest", "gone", "row", "i")
    want = brute.line_deduped([r[:2] for r in rows], 7)
    for most in (1_000_000, 0):
        out = line_dedup(docs, min_docs=7, broadcast_keys=most)
        assert out.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
        assert {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.text)) for r in out.collect()} == want
    assert line_dedup(brute.empty(spark)).count() == 0


def test_token_counts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for docs in (spark.read.parquet(f"{brute.SF}/documents.parquet"), brute.with_clashes(brute.odd(spark), "n_tokens", "n_bytes")):
        want = {d: (len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for d, t in brute.rows_of(docs)}
        assert by_id(token_counts(docs, queries.PIECES)) == want
    assert token_counts(brute.empty(spark), queries.PIECES).count() == 0


def test_transducer_equals_the_library_on_random_texts():
    t = Transducer(queries.PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    r, spelled = random.Random(3), t.spelled
    signs = ["a", "b", "e", "t", "h", " ", " ", "\n", "é", "ß", "漢", "0", ".", "-", "\t", "▁", "😀", "\0", "the", "ation", "  "]
    texts = []
    for _ in range(5000):
        texts.append("".join(r.choice(signs) for _ in range(r.randint(0, 40))))
        texts.append("".join(r.choice(spelled) for _ in range(r.randint(1, 12))))
        texts.append("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 60))))
    texts += [" " * k + end for k in range(40) for end in ("", "the", "x")]
    assert [t.count(x) for x in texts] == [len(x) for x in model.encode(texts)]
    assert len(texts) > 15_000


def test_chunk_maps_compose_to_the_whole():
    t = Transducer(queries.PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for text in ("  Two  spaces\n\n a ▁b x" + "y" * 300 + " end  \n" + "the cat sat " * 50 + "<s> ñ\0 ", "ab" * 700, " " * 100, "\n\n"):
        whole, want = t.prepared(text), len(model.encode(text))
        for size in (1, 2, 3, 7, 50, 10_000):
            maps = [t.chunk(whole[i : i + size]) for i in range(0, len(whole), size)]
            left, right = maps[0], maps[-1]
            for m in maps[1:]:
                left = t.compose(left, m)
            for m in maps[-2::-1]:
                right = t.compose(m, right)
            other = Transducer(queries.PIECES)  # states are read alike by another worker
            for m in (left, right):
                assert other.apply(m._replace(tail=other.unpacked(t.packed(m.tail))), other.start)[1] == want


def test_long_texts_are_counted_in_chunks(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    rows = [(1, "abcab" * 3000), (2, "the cat\nsat  on " * 1000), (2, "the cat\nsat  on " * 1000), (3, "short"), (4, None), (None, "é漢" * 4000), (5, "x" * 10_001 + " " * 3000)]
    docs = brute.with_clashes(spark.createDataFrame(rows, "doc_id int, text string"), "digest", "id", "at")
    got = token_counts(docs, queries.PIECES, split_chars=5000, chunk_chars=777)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((d, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096)) for d, t in rows)


def test_line_dedup_counts_rows_whatever_their_ids(spark):
    rows = [(1, "same\nown")] * 9 + [(None, "same")]
    got = sorted(map(repr, ((r.doc_id, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect())))
    assert got == sorted(map(repr, [(1, "own")] * 9 + [(None, "")]))


def test_items_without_id_hit_and_clean(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x")], "doc_id int, text string")
    bench = spark.createDataFrame([(None, "b c")], "item_id long, text string")
    assert by_id(decontaminate(docs, bench)) == {1: (3, 2, 0, [], True), 2: (1, 0, 0, [], False)}
    assert [r.doc_id for r in without_contaminated(docs, bench).collect()] == [2]


def test_later_batches_are_added_to_stored_runs(spark):
    r = random.Random(7)
    rows = [(i, "\n".join(f"line {r.randrange(3 + i % 7)}" if r.random() < 0.7 else f"own {i} {k}" for k in range(r.randint(0, 12)))) for i in range(220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = LineRuns(spark, min_docs=25, fanout=3, buckets=5)
    for batch in range(11):
        add_batch(runs, docs.where(f"doc_id % 11 = {batch}"))
        for level, own in enumerate(runs.levels):
            assert len(own) < 3 and sum(3**k * len(x) for k, x in enumerate(runs.levels)) == batch + 1, level
        for path in [x for own in runs.levels for x in own] + runs.saturated:
            spark.sql(f"DROP TABLE IF EXISTS archloom_{path.rsplit('/', 1)[1].replace('-', '_')}")  # as in another session
        runs = LineRuns.restore(spark, runs.state())
        read = [x for x in rows if x[0] % 11 <= batch]
        if batch in (0, 4, 10):
            out = without_lines(spark.createDataFrame(read, "doc_id long, text string"), runs.frequent())
            assert {x.doc_id: (x.n_lines, x.n_dropped, brute.sha(x.text)) for x in out.collect()} == brute.line_deduped(read, 25)
    assert 0 < len(runs.saturated) < 3
    sums = {}
    for path in [x for own in runs.levels for x in own]:
        for x in runs.table(path).collect():
            sums.setdefault((path, x.h1, x.h2), []).append(x.n)
    assert all(len(n) == 1 for n in sums.values())  # a key stands once in a run
    plan = runs._merged([x for own in runs.levels for x in own][:2])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "SortMergeJoin" in plan
