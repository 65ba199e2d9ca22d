"""Personal data: high-recall generators, boosted trees over their spans, calibrated thresholds.

The four base kinds are found by fixed patterns and always stay. Looser generators propose further spans that may
overlap them and each other (disguised addresses, national phone numbers, grouped card numbers, IPv6 addresses, identity
numbers, passwords, keys of services, key files); boosted trees score each from its format and context, a span is taken where its
calibrated probability reaches its kind's threshold, and of overlapping added ones the most probable stays.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from ipaddress import IPv6Address
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from archloom.llm.boosting import BoostedTrees
from archloom.llm.common import arrow_type, only, text_rows

#: Base kinds first, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE = KINDS[:4]


class Span(NamedTuple):
    kind: str
    start: int
    end: int


DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A digit run matches as a whole or not at all, so a match never needs to start inside one.
QUAD = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each base kind that pass its test."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append(Span("email", start, tail.end()))
            free = tail.end()
        at = text.find("@", max(at + 1, free))
    if not DIGIT.search(text):
        return found
    for m in QUAD.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            found.append(Span("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(Span("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                found.append(Span("phone", *m.span()))
    return found


def is_ipv6(text: str) -> bool:
    try:
        return text.count(":") > 1 and IPv6Address(text) is not None
    except ValueError:
        return False


def none(_: str) -> bool:
    return True


class Generator(NamedTuple):
    """signs: what a text must hold, in lower case, for the pattern to be tried (a digit if there are none); the group s, if
    there is one, is the span. Every repeat without an upper bound stops at the first character outside its class and no
    match can start inside another's run, so a text is read in time proportional to its length."""

    kind: str
    signs: tuple[str, ...]
    pattern: re.Pattern
    check: Callable[[str], bool] = none


def generator(kind: str, signs: tuple[str, ...], pattern: str, check: Callable[[str], bool] = none) -> Generator:
    return Generator(kind, signs, re.compile(pattern), check)


GENERATORS = (
    generator("phone", (), r"\(?(?<![0-9+])[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    generator("phone", (), r"(?<![0-9+])00[1-9][ ().0-9-]{7,}[0-9]", lambda x: 9 <= len(DIGIT.findall(x)) <= 17),
    generator("card", (), r"(?<![0-9])[0-9]{4}(?:[ ./-][0-9]{4}){2,3}(?![0-9])"),
    generator("card", (), r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    generator("ssn", (), r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    generator("iban", (), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    generator("ip", (":",), r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])", is_ipv6),
    generator("ip", ("[.]", "(.)"), r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9])"),
    generator("secret", (), r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])"),
    generator("secret", ("akia", "asia"), r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    generator("secret", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), r"(?<![A-Za-z0-9_])(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{16,}"),
    generator("secret", ("sk-", "sk_", "rk_", "pk_"), r"(?<![A-Za-z0-9_-])(?:sk|rk|pk)[-_][A-Za-z0-9_-]{12,}"),
    generator("secret", ("xox",), r"(?<![A-Za-z0-9_-])xox[abeprs]-[A-Za-z0-9-]{10,}"),
    generator("secret", ("aiza",), r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    generator("secret", ("eyj",), r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    generator("secret", ("private key",), r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z0-9 ]{0,30}PRIVATE KEY-----|(?:\s*[A-Za-z0-9+/=]{40,})*)"),
    generator("secret", ("bearer",), r"(?i)(?<![A-Za-z])bearer\s{1,3}(?P<s>[A-Za-z0-9._~+/=-]{16,})"),
    generator("secret", ("token", "secret", "key", "password", "passwd", "pwd", "passphrase"), r"(?i)(?:token|secret|key|password|passwd|pwd|passphrase)[\"']?\s{0,3}(?:[=:]|\sis\s)\s{0,3}[\"']?(?P<s>[^\s\"'|]{5,})"),
    # a plain dot joins labels only without spaces, so that the end of a sentence makes no address
    generator("email", ("(at)", "[at]", "{at}", " at "), r"(?i)(?<![A-Z0-9._-])[A-Z0-9._-]++(?:\s?[\[({]at[\])}]\s?| at )[A-Z0-9-]++(?:(?:\s?[\[({]dot[\])}]\s?| dot |\.)[A-Z0-9-]++)+(?![A-Z0-9-])"),
)
#: Words near a span that speak for a kind, and some that speak against all.
HINTS = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp", "telefon"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "tarjeta", "carte", "karte"),
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "passphrase", "bearer"),
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "from", "ping"),
}
AGAINST = ("order", "invoice", "isbn", "version", "commit", "sha", "md5", "checksum", "tracking", "serial", "part no", "id:", "meeting", "was at", "look")
ENDS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "co", "eu", "info")
#: How keys of well-known services and key files begin.
PREFIXED = re.compile(r"A[KS]IA|gh[pousr]_|github_pat_|(?:sk|rk|pk)[-_]|xox[abeprs]-|AIza|eyJ|-----BEGIN")


def proposals(text: str, base: list[Span]) -> list[Span]:
    """Spans of the loose generators that no base span holds whole; they may overlap base spans and each other."""
    low, digit = text.lower(), DIGIT.search(text) is not None
    found = []
    for kind, signs, pattern, check in GENERATORS:
        if any(s in low for s in signs) if signs else digit:
            group = "s" if "s" in pattern.groupindex else 0
            found += [Span(kind, *m.span(group)) for m in pattern.finditer(text) if check(m[group])]
    if base and found:
        starts, ends, far = [], [], 0
        for s in sorted(base, key=lambda s: s.start):
            far = max(far, s.end)
            starts.append(s.start)
            ends.append(far)
        held = lambda s: (i := bisect_right(starts, s.start)) and ends[i - 1] >= s.end
        found = [s for s in found if not held(s)]
    return list(dict.fromkeys(found))


def features(text: str, span: Span) -> list[float]:
    s = text[span.start : span.end]
    before, after = text[max(0, span.start - 40) : span.start].lower(), text[span.end : span.end + 20].lower()
    digits = "".join(c for c in s if "0" <= c <= "9")
    counts = Counter(s)
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values()) if s else 0
    last = re.split(r"[\s.\[\](){}]+", s.strip(" .]})"))[-1].lower()
    letters, upper = sum(c.isalpha() for c in s), sum(c.isupper() for c in s)
    return [
        *(float(span.kind == k) for k in KINDS),
        len(s),
        len(digits),
        len(digits) / max(1, len(s)),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        sum(c in " -./" for c in s),
        letters / max(1, len(s)),
        sum(c in "0123456789abcdefABCDEF" for c in s) / max(1, len(s)),
        entropy,
        len(counts),
        float(any(h in before for h in HINTS.get(span.kind, ()))),
        float(any(h in before for h in AGAINST)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before != ""),
        float(after[:1] in "\"'" and after != ""),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(last in ENDS),
        float("[" in s or "(" in s or "{" in s),
        float(" dot " in s.lower() or "dot]" in s.lower() or "dot)" in s.lower()),
        float(digits[:1] == "0"),
        float(digits[:3] in ("000", "666") or digits[:1] == "9"),
        float(bool(PREFIXED.match(s))),
        float(bool(digits) and letters > 0),
        upper / max(1, letters),
        float(any(not c.isalnum() for c in s)),
        s.count(":"),
        float(len(last) >= 2 and last.isalpha()),
    ]


def examples(n: int, seed: int) -> list[tuple[str, str, bool]]:
    """Made sentences, each with one text that some generator proposes: (sentence, that text, whether it is personal data)."""
    r = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[int(r.integers(len(x)))]
    some = lambda signs, k: "".join(signs[i] for i in r.integers(0, len(signs), k))
    hexa = lambda k: some("0123456789abcdef", k)
    word = lambda: some(("ka", "lo", "mi", "ter", "an", "sol", "ver", "dun", "é", "ño", "sch", "eau"), int(r.integers(1, 4)))
    name = lambda: some(("ka", "lo", "mi", "ter", "an", "sol", "ver", "dun"), int(r.integers(1, 4)))
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    large = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def card() -> str:
        body = pick("4", "5", "37") + d(14)
        return next(body[:15] + c for c in "0123456789" if luhn(body[:15] + c))

    def grouped(x: str, by: str) -> str:
        return by.join(x[i : i + 4] for i in range(0, len(x), 4))

    def ipv6() -> str:
        parts = [hexa(int(r.integers(1, 5))) for _ in range(8)]
        cut = int(r.integers(2, 7))
        return pick(":".join(parts), ":".join(parts[:cut]) + "::" + parts[-1], f"2001:db8::{parts[0]}", f"fe80::{parts[0]}:{parts[1]}")

    def provider_key() -> str:
        k = lambda n: some(signs, n)
        return pick("AKIA" + some(large, 16), "ghp_" + k(36), "sk-proj-" + k(int(r.integers(12, 60))), "sk-" + k(48), "sk_live_" + k(24), "xoxb-" + d(11) + "-" + k(24), "AIza" + k(35), "eyJ" + k(30) + "." + k(60) + "." + k(40), "github_pat_" + k(40))

    def key_file() -> str:
        kind, body = pick("RSA ", "EC ", "", "OPENSSH "), "\n".join(some(signs + "+/", 64) for _ in range(int(r.integers(1, 6))))
        return f"-----BEGIN {kind}PRIVATE KEY-----" + pick("", f"\n{body}\n-----END {kind}PRIVATE KEY-----", f"\n{body}")

    password = lambda: pick(name() + d(int(r.integers(1, 5))), name() + d(2) + name(), name().title() + pick("!", "#", "_", "$", "@") + d(3), some(signs, int(r.integers(7, 16))) + d(1), name() + pick("!", "#", "_") + name().upper() + d(2))
    label = lambda: pick("token", "secret", "api_key", "password", "key", "Password", "pwd", "passwd")
    makers = (
        (True, lambda: (pick("call ", "phone: ", "tel. ", "mobile "), pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{pick('44', '49', '33')} {d(3)} {d(6)}"), "")),
        (True, lambda: ("", f"({pick('2', '3', '4', '7')}{d(2)}) {d(3)}-{d(4)}", "")),
        (False, lambda: (pick("order ", "invoice ", "part no ", "tracking ", "serial "), pick(f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", d(16), grouped(d(12), "-")), "")),
        (False, lambda: (pick("", "about ", "of "), d(int(r.integers(13, 20))), "")),
        (True, lambda: (pick("card ", "visa ", "paid with card no. ", "credit: "), grouped(card(), pick(".", "/")), "")),
        (False, lambda: (pick("isbn ", "version ", ""), grouped(d(16), pick(".", "/")), "")),
        (True, lambda: (pick("ssn ", "social security no ", "tax id "), f"{pick('1', '2', '3', '4', '5')}{d(2)}-{d(2)}-{d(4)}", "")),
        (False, lambda: (pick("order ", "ref ", "serial ", ""), f"{d(3)} {d(2)} {d(4)}", "")),
        (True, lambda: (pick("iban ", "account ", "bank: "), grouped(pick("DE", "FR", "ES", "GB") + d(18), pick("", " ")), "")),
        (False, lambda: (pick("serial ", "part no ", "version "), grouped(pick("AB", "XR", "QT") + d(18), ""), "")),
        (True, lambda: (label() + pick(" = ", ": ", "=") + pick('"', "'", ""), pick(hexa(40), hexa(32), some(signs, 32), password(), password(), password()), pick('"', "'", ""))),
        (False, lambda: (label() + pick(": ", " = ", " is "), pick(name() + name(), "required", "optional", "expired", "missing", "hidden", "invalid", word() + word() + "s", name().title()) + pick("", ".", ",", ";"), "")),
        (False, lambda: (pick("commit ", "sha ", "md5 ", "checksum "), hexa(pick(40, 32, 64)), "")),
        (True, lambda: ("", name() + "." + name() + d(2) + pick(" (at) ", "[at]", " [at] ") + name() + pick(" (dot) ", "[dot]", ".") + pick("com", "org", "de"), "")),
        (True, lambda: (pick("mail ", "contact ", "write to "), f"{name()} at {name()} dot {pick('com', 'org', 'net')}", "")),
        (False, lambda: (pick("meeting", "look", "was", "arrived") + " ", f"{name()} at {name()}.{name().title()}", "")),
        (False, lambda: ("", f"{name()} at {name()}.{pick(name(), d(2), 'The')}", "")),
        (True, lambda: (pick("", "", "key ", "export KEY=", "use "), provider_key(), "")),
        (True, lambda: ("Authorization: Bearer ", some(signs + "._-", int(r.integers(20, 60))), "")),
        (False, lambda: ("", pick("sk-", "pk_", "sk_") + "-".join(name() + "abc" for _ in range(int(r.integers(3, 5)))), "")),
        (True, lambda: ("", key_file(), "")),
        (True, lambda: (pick("", "host ", "ip ", "from ", "address "), ipv6(), "")),
        (True, lambda: (pick("", "host ", "ip "), f"{r.integers(1, 255)}{pick('[.]', '.')}{r.integers(0, 255)}.{r.integers(0, 255)}[.]{r.integers(1, 255)}", "")),
        (False, lambda: (pick("C++ ", "use ", "std"), pick("::", "a::b", "::" + hexa(1), "dead::beef::"), "")),
    )
    out = []
    for _ in range(n):
        truth, make = makers[int(r.integers(len(makers)))]
        left, right = " ".join(word() for _ in range(int(r.integers(0, 6)))), " ".join(word() for _ in range(int(r.integers(0, 6))))
        lead, core, tail = make()
        out.append((f"{left} {lead}{core}{tail} {right}.", core, truth))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 9000, seed: int = 11, precision: float = 0.98) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees fitted on two thirds of `n` made examples; scale and thresholds from the rest.

    A proposal is true if its example is and it covers most of the example's text. A kind's threshold is the least
    probability from which on at least `precision` of the held-out spans are true.
    """
    x, y, kinds, held = [], [], [], []
    for number, (text, core, truth) in enumerate(examples(n, seed)):
        start = text.index(core)
        for span in proposals(text, base_spans(text)):
            common = min(span.end, start + len(core)) - max(span.start, start)
            x.append(features(text, span))
            y.append(float(truth and common * 5 >= 4 * max(len(core), span.end - span.start)))
            kinds.append(span.kind)
            held.append(number % 3 == 0)
    xs, ys, ks, out = np.array(x), np.array(y), np.array(kinds), np.array(held)
    model = BoostedTrees().fit(xs[~out], ys[~out]).calibrate(xs[out], ys[out])
    p, yh, kh = model.predict(xs[out]), ys[out], ks[out]
    thresholds = {}
    for kind in KINDS:
        own = kh == kind
        q, t = p[own], yh[own]
        order = np.argsort(-q, kind="stable")
        good = np.flatnonzero(np.cumsum(t[order]) / np.arange(1, len(order) + 1) >= precision)
        thresholds[kind] = max(0.5, float(q[order][good[-1]])) if len(good) else 2.0
    return model, thresholds


def order(span: Span) -> tuple[int, int, int]:
    return span.start, KINDS.index(span.kind), span.end


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=order))


def find_all(texts: list[str], model: BoostedTrees, thresholds: dict[str, float]) -> list[tuple[list[Span], list[Span]]]:
    """Base and all spans of each text; the proposals of all texts are scored together."""
    base = [base_spans(t) for t in texts]
    found = [(i, s) for i, t in enumerate(texts) for s in proposals(t, base[i])]
    added: list[list[tuple[float, Span]]] = [[] for _ in texts]
    if found:
        p = model.predict(np.array([features(texts[i], s) for i, s in found]))
        for (i, s), probability in zip(found, p.tolist(), strict=True):
            if probability >= thresholds[s.kind]:
                added[i].append((probability, s))
    return [(b, b + disjoint(a)) for b, a in zip(base, added, strict=True)]


def disjoint(spans: list[tuple[float, Span]]) -> list[Span]:
    """Of overlapping spans the most probable, then the longest. Spans are swept by start; each group of spans that hang
    together is settled by itself."""
    taken: list[Span] = []
    group: list[tuple[float, Span]] = []
    far = -1
    for one in [*sorted(spans, key=lambda x: order(x[1])), None]:
        if group and (one is None or one[1].start >= far):
            starts: list[int] = []
            ends: list[int] = []
            for _, s in sorted(group, key=lambda x: (-x[0], x[1].start - x[1].end, order(x[1]))):
                i = bisect_right(starts, s.start)
                if (i == 0 or ends[i - 1] <= s.start) and (i == len(starts) or starts[i] >= s.end):
                    starts.insert(i, s.start)
                    ends.insert(i, s.end)
                    taken.append(s)
            group, far = [], -1
        if one is not None:
            group.append(one)
            far = max(far, one[1].end)
    return taken


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span (or union of overlapping ones) replaced by its kind in brackets."""
    out, free = [], 0
    for s in sorted(spans, key=order):
        if s.start >= free:
            out += [text[free : s.start], f"[{s.kind}]"]
        free = max(free, s.end)
    return "".join([*out, text[free:]])


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Personal data of every whole text. A null text counts as empty and has no spans.

    Columns: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end in code points, all
    spans), n_added, has_pii, redacted. Repeated rows give a row each; an empty table gives an empty result; further columns
    are ignored. A text is read in time proportional to its length, apart from sorting its spans. A map without shuffle; the model is fitted once on made examples and sent with the function.
    """
    model, thresholds = trained()
    kind, id_type = docs.schema[id_column].dataType.simpleString(), arrow_type(docs, id_column)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_rows(batches, id_column, text_column):
            found = find_all(texts, model, thresholds)
            counts = [Counter(s.kind for s in b) for b, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, type=id_type),
                    *(pa.array([c[k] for c in counts], type=pa.int64()) for k in BASE),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]),
                    pa.array([joined(a) for _, a in found]),
                    pa.array([len(a) - len(b) for b, a in found], type=pa.int64()),
                    pa.array([len(a) > 0 for _, a in found]),
                    pa.array([redacted(t, a) for t, (_, a) in zip(texts, found, strict=True)]),
                ],
                names=[id_column, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "has_pii", "redacted"],
            )

    schema = f"`{id_column}` {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, n_added long, has_pii boolean, redacted string"
    return only(docs, id_column, text_column).mapInArrow(find, schema)
