"""Invariants and validation: each check gives its violations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archloom.functions.text import display_units, filled

# Fixed values.
LINK_KINDS, STEP_KINDS = ("data", "control", "dispatch"), ("call", "return", "self")
EXTRA_KINDS, PART_KINDS = ("artifact", "actor"), ("code", "actor", "artifact")


def duplicate_labels(classes: DataFrame) -> DataFrame:
    """Q1: (layer, label, n, ids) of core labels that stand twice in a layer."""
    label = F.coalesce("display_name", "name").alias("label")
    return classes.where("core").groupBy("layer", label).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).where("n > 1")


def narrow_boxes(boxes: DataFrame, char_width: float, padding: float) -> DataFrame:
    """Q2: boxes (id, label, width) narrower than their label with padding on both sides, by more than one."""
    needed = F.round(display_units(F.col("label")) * F.lit(char_width)) + 2 * padding
    return boxes.withColumn("needed", needed).where(F.col("width") < F.col("needed") - 1)


def incomplete_pairs(rows: DataFrame) -> DataFrame:
    """Q3: (subject, field, state) of bilingual fields of which one half is missing, or both where required.

    rows: subject, field, zh, en, required.
    """
    zh, en = filled(F.trim("zh")).isNotNull(), filled(F.trim("en")).isNotNull()
    state = F.when(zh & ~en, "missing-en").when(en & ~zh, "missing-zh").when(~zh & ~en & F.col("required"), "missing-both")
    return rows.select("subject", "field", state.alias("state")).where(F.col("state").isNotNull())


def _pair_missing(base: str):
    return filled(F.trim(F.coalesce(f"{base}_zh", F.lit("")))).isNull() | filled(F.trim(F.coalesce(f"{base}_en", F.lit("")))).isNull()


def _errors(rows: DataFrame, **tests) -> DataFrame:
    """(diagram, rule, subject) of each test that a row (diagram, subject) fails."""
    checks = F.filter(F.array(*[F.when(test, F.lit(rule.replace("_", "-"))) for rule, test in tests.items()]), lambda r: r.isNotNull())
    return rows.select("diagram", F.explode(checks).alias("rule"), "subject")


def _none(diagrams: DataFrame, rows: DataFrame, rule: str, least: int = 1) -> DataFrame:
    counted = diagrams.select("diagram").join(rows.groupBy("diagram").agg(F.count("*").alias("n")), "diagram", "left")
    return counted.where(F.coalesce("n", F.lit(0)) < least).select("diagram", F.lit(rule).alias("rule"), F.lit("").alias("subject"))


def validate_sequences(diagrams: DataFrame, participants: DataFrame, steps: DataFrame, decls: DataFrame) -> DataFrame:
    """Q5: (diagram, rule, subject). participants: diagram, pos, id, kind, name_zh, name_en, nodes; steps: diagram, pos,
    src, dst, kind, label_zh, label_en; decls: id."""
    pid = F.coalesce("id", F.lit(""))
    nth = F.row_number().over(W.partitionBy("diagram", "id").orderBy("pos"))
    parts = participants.withColumn("nth", nth).withColumn("subject", pid).withColumn("k", F.coalesce("kind", F.lit("code")))
    own = _errors(
        parts, participant_id=~pid.startswith("p:") | (F.col("nth") > 1), participant_name=_pair_missing("name"), participant_kind=~F.col("k").isin(*PART_KINDS),
        participant_nodes=(F.col("k") == "code") & (F.coalesce(F.size("nodes"), F.lit(0)) <= 0),
    )
    named = parts.where(F.col("k") == "code").select("diagram", "subject", F.explode("nodes").alias("node"))
    unknown = named.join(decls.select(F.col("id").alias("node")), "node", "left_anti").select("diagram", F.lit("participant-decl").alias("rule"), "subject")
    ids = participants.select("diagram", "id").distinct()
    ends = steps.join(ids.select("diagram", F.col("id").alias("src"), F.lit(True).alias("_s")), ["diagram", "src"], "left").join(ids.select("diagram", F.col("id").alias("dst"), F.lit(True).alias("_d")), ["diagram", "dst"], "left")
    kind = F.coalesce("kind", F.lit("call"))
    flow = _errors(
        ends.withColumn("subject", F.concat_ws("->", "src", "dst")), step_from=F.col("_s").isNull(), step_to=F.col("_d").isNull(), step_label=_pair_missing("label"),
        step_kind=~kind.isin(*STEP_KINDS), self_step=(kind == "self") & ~F.col("src").eqNullSafe(F.col("dst")),
    )
    return own.unionByName(unknown).unionByName(flow).unionByName(_none(diagrams, participants, "few-participants", 2)).unionByName(_none(diagrams, steps, "no-steps"))


def validate_pipelines(diagrams: DataFrame, stages: DataFrame, extras: DataFrame, links: DataFrame, flow_nodes: DataFrame, decls: DataFrame) -> DataFrame:
    """Q4: (diagram, rule, subject). stages: diagram, pos, id, name_zh, name_en, nodes; extras: diagram, pos, id, kind, name,
    stage; links: diagram, src, dst, kind, label_zh, label_en; flow_nodes: diagram, node; decls: id."""
    sid = F.coalesce("id", F.lit(""))
    staged = stages.withColumn("nth", F.row_number().over(W.partitionBy("diagram", "id").orderBy("pos"))).withColumn("subject", sid)
    own = _errors(staged, stage_id=(sid == "") | (F.col("nth") > 1), stage_name=_pair_missing("name"), stage_nodes=F.coalesce(F.size("nodes"), F.lit(0)) <= 0)
    placed = staged.select("diagram", "pos", "subject", F.posexplode("nodes").alias("at", "node"))
    nth = F.row_number().over(W.partitionBy("diagram", "node").orderBy("pos", "at"))
    seen = placed.withColumn("nth", nth).join(flow_nodes.select("diagram", "node", F.lit(True).alias("_f")).distinct(), ["diagram", "node"], "left").join(decls.select(F.col("id").alias("node"), F.lit(True).alias("_d")).distinct(), "node", "left")
    nodes = _errors(seen.withColumn("subject", F.concat_ws("/", "subject", "node")), node_not_in_flow=F.col("_f").isNull(), node_unknown=F.col("_d").isNull(), node_twice=F.col("nth") > 1)
    xid = F.coalesce("id", F.lit(""))
    known = decls.select("id", F.lit(True).alias("_d")).distinct()
    more = extras.withColumn("nth", F.row_number().over(W.partitionBy("diagram", "id").orderBy("pos"))).join(known, "id", "left").join(stages.select("diagram", F.col("id").alias("stage"), F.lit(True).alias("_s")).distinct(), ["diagram", "stage"], "left")
    extra = _errors(
        more.withColumn("subject", xid), extra_id=~xid.startswith("x:") | (F.col("nth") > 1) | F.col("_d").isNotNull(), extra_kind=~F.coalesce(F.col("kind").isin(*EXTRA_KINDS), F.lit(False)),
        extra_name=filled(F.trim(F.coalesce("name", F.lit("")))).isNull(), extra_stage=F.col("stage").isNotNull() & F.col("_s").isNull(),
    )
    ends = stages.select("diagram", "id").unionByName(extras.select("diagram", "id")).unionByName(placed.select("diagram", F.col("node").alias("id"))).distinct()
    tied = links.join(ends.select("diagram", F.col("id").alias("src"), F.lit(True).alias("_s")), ["diagram", "src"], "left").join(ends.select("diagram", F.col("id").alias("dst"), F.lit(True).alias("_d")), ["diagram", "dst"], "left")
    link = _errors(tied.withColumn("subject", F.concat_ws("->", "src", "dst")), link_from=F.col("_s").isNull(), link_to=F.col("_d").isNull(), link_label=_pair_missing("label"), link_kind=F.col("kind").isNotNull() & ~F.col("kind").isin(*LINK_KINDS))
    return own.unionByName(nodes).unionByName(extra).unionByName(link).unionByName(_none(diagrams, stages, "no-stages")).unionByName(_none(diagrams, links, "no-links"))


def displayable(diagrams: DataFrame, errors: DataFrame) -> DataFrame:
    """Q8: diagrams (diagram, ord) without error; the default is the first in order."""
    good = diagrams.join(errors.select("diagram").distinct(), "diagram", "left_anti")
    first = good.agg(F.min(F.struct("ord", "diagram")).alias("first"))
    return good.crossJoin(F.broadcast(first)).withColumn("is_default", F.struct("ord", "diagram") == F.col("first")).drop("first")


def changes(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Q7: rows of one frame that the other lacks, with `side`, fractions rounded."""
    names = a.columns
    rounded = lambda df: df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.select(*names).dtypes])
    x, y = rounded(a), rounded(b)
    return x.exceptAll(y).withColumn("side", F.lit("removed")).unionByName(y.exceptAll(x).withColumn("side", F.lit("added")))


def violations(**checks: DataFrame) -> DataFrame:
    """Q6, K9: (rule, subject) of several checks, each a frame with `subject`."""
    out = None
    for rule, df in checks.items():
        one = df.select(F.lit(rule).alias("rule"), F.col("subject").cast("string").alias("subject"))
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """A21."""
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def missing(expected: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Expectations that no row meets."""
    return expected.join(rows.select(*on).distinct(), on, "left_anti")
