import re

import numpy as np
from tests.llm import brute

import corpus_pipeline
from archloom.llm import queries
from archloom.llm.quality_rules import LineRules, quality_rules
from archloom.llm.segmentation import Vocabulary


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) in plain Python."""
    w = brute.words(text)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_quality_counts(spark):
    for docs in (spark.read.parquet(f"{brute.SF}/documents.parquet"), brute.with_clashes(brute.odd(spark), "w", "l", "kept")):
        got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect()}
        assert got == {d: quality(t) for d, t in brute.rows_of(docs)}
    assert quality_rules(brute.empty(spark)).count() == 0


def test_lines_are_judged_one_by_one(spark):
    prose = "%d0 %d1 %d2 %d3 %d4 quick brown %d5 %d6 lazy dog %d7 %d8 and home, as %d9 before."
    bad = ["Home | News | Sport | Contact", "BUY!! NOW!! CHEAP!! HERE!!", "Read more", "We use cookies and a privacy policy.", "a### b*** c&&& d$$$", "Tous droits réservés 2020", "Hier klicken", "Volver arriba, por favor", "Home", "News and sport", "Contact"]
    good = [prose.replace("%d", str(i)) for i in range(8)] + ["", "Short end.", "A heading", prose.replace("%d", "9"), "Another one", "", "A third"]
    good += [""]  # a heading that stands before a menu would be part of it
    docs = spark.createDataFrame([(1, "\n".join(good + bad)), (2, "\n".join(f"{x} | {i} | {i * 7}" for i, x in enumerate(bad * 12))), (3, "\n".join(good))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules(docs, with_text=True).collect()}
    assert got[1].clean_text == "\n".join(good) and got[1].n_failed_lines == len(bad) and got[1].kept
    assert not got[2].kept and got[3].kept and got[3].n_failed_lines == 0
    assert quality_rules(docs, rules=LineRules(max_lost_pct=0)).where("kept").count() == 1


def test_no_python_in_the_quality_rules(spark):
    plan = queries.op9_quality_rules(spark, brute.SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|hashpartitioning", plan)


def test_pipeline_equals_brute_force(spark):
    folder = brute.SF
    judged = {r.doc_id: r for r in quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), with_text=True).collect()}
    docs = [(d, r.clean_text) for d, r in judged.items() if r.kept and not quality(r.clean_text)[0] == 0]
    held = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    for d, t in docs:
        for k in {key(x) for x in t.split("\n")}:
            held.setdefault(k, set()).add(d)
    docs = [(d, "\n".join(x for x in t.split("\n") if not key(x) or len(held[key(x)]) < 10)) for d, t in docs]
    near = brute.near_components(docs, 80)
    docs = [(d, t) for d, t in docs if near[d][2]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = brute.decontaminated(docs, items)
    docs = [(d, t) for d, t in docs if not hit[d][4]]
    v = Vocabulary(queries.PIECES)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {d for d, _ in docs}
    for d, t in docs:
        score, packed, _ = v.encode(t)
        assert got[d].ids == np.frombuffer(packed, dtype="<i4").tolist() and got[d].score == score and got[d].round_trip
        assert v.decode(got[d].ids) == t


def test_rows_of_one_id_with_different_texts_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, c + " more"), (6, ""), (6, ""), (6, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, number string")
    out = corpus_pipeline.one_of_each_group(spark, docs, brute.SF)
    want = [(1, a, "x"), (2, b, "x"), (4, c, "x"), (6, "", "x"), (6, None, "x"), (None, a, "x"), (None, a, "x")]
    assert out.columns == docs.columns and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_each_stage_takes_odd_rows(spark):
    for docs in (brute.odd(spark), brute.empty(spark), brute.odd(spark).union(brute.odd(spark)), brute.with_clashes(brute.odd(spark), "kept", "n_words", "clean_text", "n_lines")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, brute.SF)
            assert out.columns == docs.columns or name == "segmentation" or set(docs.columns) - set(out.columns) == {"n_lines"}
            out.count()
