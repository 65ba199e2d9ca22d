"""Line-first cleaning of documents, in DataFrame functions alone.

Each line is judged by a punctuation, a navigation and a boilerplate rule; lines that fail are removed;
a document that loses too much of its text is rejected. Everything is computed within the row: no shuffle,
no Python. Arrays that a lambda needs more than once are bound by `let`, so they are built once a row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture in four languages, compared in lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "terms and conditions", "cookie policy", "use cookies",
    "enable javascript", "javascript is disabled", "click here", "subscribe to our", "sign up for", "log in to", "share this",
    "read more", "back to top", "skip to content", "lorem ipsum", "powered by", "copyright (c)", "©",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "cliquez ici", "lire la suite", "retour en haut", "abonnez-vous à",
    "todos los derechos reservados", "política de privacidad", "términos y condiciones", "utiliza cookies", "haga clic aquí", "leer más", "volver arriba", "suscríbete a",
    "alle rechte vorbehalten", "datenschutzerklärung", "geschäftsbedingungen", "verwendet cookies", "hier klicken", "weiterlesen", "zum seitenanfang", "newsletter abonnieren",
)


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    #: a document fails if more than this share of its words stands in repeated three-word windows
    max_repeat_pct: int = 50
    #: runs of marks such as *** or !! at one word in this many make a line noise
    noise_every: int = 5
    #: column marks standing alone at one word in this many make a line navigation
    navigation_every: int = 4
    #: lines this short without a mark at their end are a menu where two or more follow each other; a single one is a heading
    short_line_words: int = 4
    #: a longer line may hold a phrase of page furniture in passing
    boilerplate_words: int = 40
    #: share of word characters that may be lost
    max_lost_pct: int = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda w: w != "")


def count_of(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def repeated_words(ws: Column) -> Column:
    """How many words stand in three-word windows that are found twice or more in the array."""

    def covered(starts: Column) -> Column:
        inner = F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.try_element_at(starts, i + 2) - s, F.lit(3))))
        return F.aggregate(inner, F.lit(0), lambda a, x: a + x)

    def twice(grams: Column) -> Column:
        same = lambda g, i: g["h"] == F.get(grams, i)["h"]
        hit = F.filter(grams, lambda g, i: F.coalesce(same(g, i - 1), F.lit(False)) | F.coalesce(same(g, i + 1), F.lit(False)))
        return let(F.sort_array(F.transform(hit, lambda g: g["i"])), covered)

    grams = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(F.sort_array(grams), twice))


def line_fails(line: Column, furnished: Column, rules: LineRules) -> Column:
    """(bad, short): whether a line with words is noise, navigation or boilerplate; whether it may be part of a menu.
    Blank lines are neither. furnished: whether the text has any phrase of page furniture."""

    def judged(x: Column) -> Column:
        plain, low, n = x["plain"], x["low"], x["n"]
        noise = F.regexp_count(plain, F.lit(r"[#*$%&<>]{2,}|[!?]{2,}")) * rules.noise_every >= n
        navigation = (n >= 3) & (F.regexp_count(plain, F.lit(r"(^| )[|>»·•]( |$)")) * rules.navigation_every >= n)
        furniture = F.when(furnished & (n <= rules.boilerplate_words), reduce(or_, (low.contains(phrase) for phrase in BOILERPLATE))).otherwise(F.lit(False))
        short = (n > 0) & (n < rules.short_line_words) & ~plain.rlike("[\\p{Punct}…”»。]$")
        return F.struct(((n > 0) & (noise | navigation | furniture)).alias("bad"), short.alias("short"))

    plain = F.trim(F.regexp_replace(line, r"[ \t\x0b\f\r]+", " "))
    spaced = let(plain, lambda p: F.struct(p.alias("plain"), F.lower(p).alias("low"), F.when(p == "", 0).otherwise(count_of(p, " ") + 1).alias("n")))
    return let(spaced, judged)


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: LineRules = LineRules(), with_text: bool = False, carry: bool = False) -> DataFrame:
    """One row a document: the counts, the verdict and, with_text, what is left of the text.

    Null and empty texts have no words, fail the base rule and are rejected; repeated rows are judged alike, each
    for itself; a very long text takes a small multiple of its size in its task; an empty table gives an empty result. Further
    columns of the input are ignored.
    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, lost_chars,
    base_failed, kept, and clean_text. carry adds `row`, a struct of the input's columns.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    carried = ["_row"] * carry
    seen = docs.select(F.col(id_column), text.alias("_text"), *([F.struct(*docs.columns).alias("_row")] * carry))
    has_word = lambda line: F.length(F.translate(line, SPACE, "")) > 0
    per_words = let(words(F.col("_text")), lambda ws: F.struct(F.size(ws).alias("n"), repeated_words(ws).alias("r")))

    def by_line(split: Column) -> Column:
        lines, furnished = split["lines"], split["furnished"]
        first = F.transform(lines, lambda line: F.struct(line.alias("line"), line_fails(line, furnished, rules).alias("is")))
        near = lambda js, i: F.coalesce(F.get(js, i)["is"]["short"], F.lit(False))
        menus = lambda js: F.transform(js, lambda j, i: F.struct(j["line"].alias("line"), (j["is"]["bad"] | (j["is"]["short"] & (near(js, i - 1) | near(js, i + 1)))).alias("bad")))
        judged = let(first, menus)
        wordy = F.filter(lines, has_word)

        def summed(js: Column) -> Column:
            bad = F.filter(js, lambda j: j["bad"])
            return F.struct(
                F.size(js).alias("n"),
                F.size(bad).alias("bad"),
                F.aggregate(bad, F.lit(0), lambda a, j: a + F.length(F.translate(j["line"], SPACE, ""))).alias("lost"),
                *([F.array_join(F.transform(F.filter(js, lambda j: ~j["bad"]), lambda j: j["line"]), "\n").alias("clean")] * with_text),
                let(wordy, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
            )

        return let(judged, summed)

    parts = seen.select(
        id_column,
        *carried,
        per_words.alias("w"),
        let(F.struct(F.split("_text", "\n").alias("lines"), let(F.lower("_text"), lambda low: reduce(or_, (low.contains(phrase) for phrase in BOILERPLATE))).alias("furnished")), by_line).alias("l"),
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        count_of(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
    )
    n_words, n_repeat, lost = F.col("w.n").cast("long"), F.col("w.r").cast("long"), F.col("l.lost").cast("long")
    base_failed = (n_words < rules.min_words) | (n_repeat * 100 > n_words * rules.max_repeat_pct)
    return parts.select(
        id_column,
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
        F.col("l.bad").cast("long").alias("n_failed_lines"),
        lost.alias("lost_chars"),
        base_failed.alias("base_failed"),
        (~base_failed & (lost * 100 <= F.col("word_chars") * rules.max_lost_pct)).alias("kept"),
        *([F.col("l.clean").alias("clean_text")] * with_text),
        *(F.col(c).alias("row") for c in carried),
    )
