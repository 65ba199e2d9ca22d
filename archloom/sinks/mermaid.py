"""K6: diagrams as Mermaid text, for frames of sequence steps and for single diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.operators.quality import LINK_KINDS

#: How kinds of links are drawn, in the order of LINK_KINDS.
LINK_ARROWS = dict(zip(LINK_KINDS, ("-->", "-.->", "==>"), strict=True))


def quoted(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit("#quot;")), "[\r\n]+", " ")


def message(text: Column) -> Column:
    return F.replace(quoted(text), F.lit(";"), F.lit("،"))


def sequences(steps: DataFrame) -> DataFrame:
    """(diagram, text) of steps (diagram, pos, src, label), each to the next one's src; the last goes to itself.

    Participants get short names in the order in which they first appear.
    """
    rows = steps.groupBy("diagram").agg(F.array_sort(F.collect_list(F.struct("pos", "src", "label"))).alias("s"))
    people = F.array_distinct(F.transform("s", lambda x: x["src"]))
    named = rows.select("diagram", "s", people.alias("p"))
    alias = lambda who: F.concat(F.lit("a"), (F.array_position("p", who) - 1).cast("string"))
    heads = F.transform("p", lambda who: F.concat(F.lit("  participant "), alias(who), F.lit(" as "), quoted(who)))

    def line(x: Column, i: Column) -> Column:
        following = F.coalesce(F.get("s", i + 1)["src"], x["src"])
        return F.concat(F.lit("  "), alias(x["src"]), F.lit("->>"), alias(following), F.lit(": "), (i + 1).cast("string"), F.lit(". "), message(x["label"]))

    text = F.array_join(F.concat(F.array(F.lit("sequenceDiagram")), heads, F.transform("s", line)), "\n")
    return named.select("diagram", text.alias("text"))


class _Names:
    def __init__(self, letter: str) -> None:
        self.letter, self.of = letter, {}

    def __call__(self, key) -> str:
        return self.of.setdefault(key, f"{self.letter}{len(self.of)}")


def _plain(text) -> str:
    import re

    return re.sub(r"[\r\n]+", " ", str(text or "").replace('"', "#quot;"))


def pick(row: dict, base: str, language: str) -> str:
    other = "en" if language == "zh" else "zh"
    return row.get(f"{base}_{language}") or row.get(f"{base}_{other}") or row.get(base) or ""


def compile_diagram(diagram: dict, labels: dict[str, str], language: str = "en", callback: str = "flowClick") -> tuple[str, dict[str, str]]:
    """One diagram (as in the model) to text, and which declaration each short name stands for. A click calls `callback`."""
    if diagram.get("type") == "sequence":
        return _sequence(diagram, language)
    name, shown, lines, clicks = _Names("n"), {}, ["flowchart LR"], []
    stages = diagram.get("stages") or []
    for stage in stages:
        lines.append(f'  subgraph {name(stage["id"])}["{_plain(pick(stage, "name", language))}"]')
        for node in stage.get("nodes") or []:
            own = name(node)
            lines.append(f'    {own}["{_plain(labels.get(node, node))}"]')
            shown[own] = node
            clicks.append(f'  click {own} call {callback}("{_plain(node)}")')
        lines.append("  end")
    for extra in diagram.get("extra_nodes") or []:
        left, right = ('(["', '"])') if extra.get("kind") == "actor" else ('[/"', '"/]')
        lines.append(f"  {name(extra['id'])}{left}{_plain(extra.get('name'))}{right}")
    first = {s["id"]: s["nodes"][0] for s in stages if s.get("nodes")}
    for link in diagram.get("links") or []:
        ends = [name(first.get(link[k], link[k])) for k in ("from", "to")]
        arrow = LINK_ARROWS.get(link.get("kind"), LINK_ARROWS["data"])
        lines.append(f'  {ends[0]} {arrow}|"{_plain(pick(link, "label", language))}"| {ends[1]}')
    return "\n".join(lines + clicks), shown


def _sequence(diagram: dict, language: str) -> tuple[str, dict[str, str]]:
    name, shown, lines = _Names("a"), {}, ["sequenceDiagram"]
    for part in diagram.get("participants") or []:
        own = name(part["id"])
        lines.append(f"  {'actor' if part.get('kind') == 'actor' else 'participant'} {own} as {_plain(pick(part, 'name', language))}")
        if part.get("nodes"):
            shown[own] = part["nodes"][0]
    for i, step in enumerate(diagram.get("steps") or [], 1):
        arrow = "-->>" if step.get("kind") == "return" else "->>"
        lines.append(f"  {name(step['from'])}{arrow}{name(step['to'])}: {i}. {_plain(pick(step, 'label', language)).replace(';', '،')}")
    return "\n".join(lines), shown
