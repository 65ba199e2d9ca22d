"""Plain-Python versions of the contracts, and the odd rows every operator is tried on."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (4, "One line only.", None, "a", 14),
    (5, "One line only.", "en", None, 14),
    (6, "é ü ß ▁ ｆｕｌｌ ​ x\x00y", "en", "a", None),
    (7, LONG, "en", "a", len(LONG)),
    (8, LONG + " tail", "en", "a", len(LONG) + 5),
    (9, "a" * 5000, "en", "a", 5000),
    (10, "\n".join(["Same line here, again."] * 40), "en", "a", 900),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def with_clashes(df, *names):
    """df with further columns whose names the operator uses itself."""
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def decontaminated(docs, items, size=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].update([] if item is None else [str(item)])
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= owners
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def line_deduped(docs, least=10):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))

    held = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def near_components(docs, pct=85):
    sets = {}
    for d, t in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter((a, b) for ds in holders.values() for a in ds for b in ds if a < b)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= pct * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def suffix_deduped(docs, size=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def substring_deduped(docs, size=35):
    held = Counter(tuple(w[i : i + size]) for _, t in docs for w in [words(t)] for i in range(len(w) - size + 1))
    out = {}
    for d, t in docs:
        w, gone = words(t), set()
        for i in range(len(w) - size + 1):
            if held[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
