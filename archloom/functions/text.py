"""Column functions over names, paths, labels and signatures."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.config import ENTRY_POINTS, EXCLUDED_TAG


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def qualified_name(namespace: Column, name: Column) -> Column:
    """Namespace.name, or name alone."""
    return F.concat_ws(".", filled(namespace), name)


def short_name(raw: Column) -> Column:
    """What stands before < and (, then the last of its parts at . :: /; null if nothing is left."""
    head = F.regexp_replace(raw, r"[<(][\s\S]*$", "")
    return filled(F.element_at(F.split(head, r"\.|::|/"), -1))


def module_token(namespace: Column, path: Column) -> Column:
    """The last part of the namespace, else the file's stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.element_at(F.split(filled(namespace), "[./]"), -1), stem)


def identifiers(text: Column) -> Column:
    """P5: distinct whole identifiers."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))


def is_entry_point(name: Column) -> Column:
    """P6."""
    return name.isin(*ENTRY_POINTS)


def package_root(namespace: Column) -> Column:
    """The first two parts; empty for null."""
    return F.coalesce(F.substring_index(namespace, ".", 2), F.lit(""))


def has_excluded_tag(tags: Column) -> Column:
    """P10."""
    return F.coalesce(F.exists(tags, lambda t: F.lower(t).rlike(EXCLUDED_TAG)), F.lit(False))


def context_segments(namespace: Column, path: Column) -> Column:
    """Parts of the namespace, else of the path without its extension."""
    stem = F.filter(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\.[^./]+$", ""), "/"), lambda s: s != "")
    return F.when(filled(namespace).isNotNull(), F.split(namespace, r"\.")).otherwise(stem)


CJK = "[㐀-鿿]"
PAIR_MARKS = (" · ", " / ", " | ", " — ")


def bilingual(zh: Column, en: Column, joined: Column, language: str) -> Column:
    """The half in the language, else the other; else a joined text is split where just one half has CJK."""
    own, other = (zh, en) if language == "zh" else (en, zh)
    out = joined
    for mark in reversed(PAIR_MARKS):
        a, b = F.split_part(joined, F.lit(mark), F.lit(1)), F.split_part(joined, F.lit(mark), F.lit(2))
        one = joined.contains(mark) & (a.rlike(CJK) != b.rlike(CJK))
        chinese = F.when(a.rlike(CJK), a).otherwise(b)
        latin = F.when(a.rlike(CJK), b).otherwise(a)
        out = F.when(one, chinese if language == "zh" else latin).otherwise(out)
    return F.coalesce(filled(F.trim(own)), filled(F.trim(other)), out, F.lit(""))


def display_units(label: Column) -> Column:
    """Two for each code point beyond U+2E7F, one for any other."""
    return F.length(label) + F.length(F.regexp_replace(label, "[\\x{0}-\\x{2E7F}]", ""))


def without_comments(text: Column) -> Column:
    """JSON with comments and trailing commas made plain."""
    text = F.regexp_replace(text, r"/\*[\s\S]*?\*/", "")
    text = F.regexp_replace(text, r"(?m)(^|[^:])//.*$", "$1")
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def repository_name(url: Column) -> Column:
    """owner__repo of an address."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), "[/:]")
    return F.concat_ws("__", F.element_at(parts, -2), F.element_at(parts, -1))


def porcelain_path(line: Column) -> Column:
    """The path of a status line: three characters of status go, of a rename its target stays, quotes go."""
    body = F.trim(F.substring(line, 4, 1_000_000))
    target = F.element_at(F.split(body, " -> "), -1)
    return filled(F.regexp_replace(target, '^"|"$', ""))


def jaccard(a: Column, b: Column) -> Column:
    """J14 on arrays of distinct values: two empty sets have 0."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


OPEN, CLOSE = "([{<", ")]}>"


def _closing(text: str, at: int, opening: str, closing: str) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == opening) - (text[i] == closing)
        if depth == 0:
            return i
    return -1


def _plain_parameters(raw: str) -> str:
    """Parameters without default values, which end at a comma or bracket of their own level; white space collapsed."""
    kept, level, skip = [], 0, None
    for i, c in enumerate(raw):
        if skip is None and c == "=" and level == 0 and raw[i + 1 : i + 2] != "=":
            skip = 0
            continue
        if skip is not None:
            if c in OPEN:
                skip += 1
                continue
            if c in CLOSE and skip:
                skip -= 1
                continue
            if not (skip == 0 and (c == "," or c in CLOSE)):
                continue
            skip = None
        level += (c in OPEN) - (c in CLOSE)
        kept.append(c)
    text = re.sub(r"\s*,\s*", ", ", re.sub(r"\s+", " ", "".join(kept))).strip()
    return re.sub(",$", "", text).strip()


def split_signature(signature: str | None, name: str | None) -> tuple[str, str] | None:
    """(parameters, return type) of a declaration header; None where it can't be read."""
    if not signature or not name:
        return None
    start = -1
    for m in re.finditer(rf"(?:^|(?<=[^A-Za-z0-9_$])){re.escape(name)}(?![A-Za-z0-9_$])", signature):
        at = m.end()
        if signature[at : at + 1] == "<":
            at = _closing(signature, at, "<", ">") + 1
            if not at:
                continue
        while signature[at : at + 1].isspace():
            at += 1
        if signature[at : at + 1] == "(":
            start = at
            break
    end = _closing(signature, start, "(", ")") if start >= 0 else -1
    if end < 0:
        return None
    tail = re.sub(r"\b(async|throws|rethrows)\b", " ", signature[end + 1 :])
    arrow = re.search(r"(->|→)\s*", tail)
    returned = re.sub(r"[:{\s]+$", "", re.sub(r"\bwhere\b[\s\S]*$", "", tail[arrow.end() :])).strip() if arrow else ""
    return _plain_parameters(signature[start + 1 : end]), returned


PARTS = T.StructType([T.StructField("selector", T.StringType()), T.StructField("returned", T.StringType()), T.StructField("ok", T.BooleanType())])


@F.pandas_udf(PARTS)
def signature_parts(signature: pd.Series, name: pd.Series) -> pd.DataFrame:
    found = [split_signature(s, n) for s, n in zip(signature, name, strict=True)]
    return pd.DataFrame({"selector": [f and f[0] for f in found], "returned": [f and f[1] for f in found], "ok": [f is not None for f in found]})
