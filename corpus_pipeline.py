"""A training-corpus pipeline: five stages over `documents`, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.llm.common import materialise, table
from archloom.llm.decontamination import without_contaminated
from archloom.llm.line_dedup import line_dedup
from archloom.llm.near_dedup import NearRules, near_dedup
from archloom.llm.quality_rules import quality_rules
from archloom.llm.queries import PIECES
from archloom.llm.segmentation import encode_texts

#: Near copies share 80 of 100 five-word shingles or more; 38 bands of 5 minima miss such a pair with probability 3e-7.
NEAR = NearRules(min_pct=80, bands=38, rows=5)
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Exact shingle-set components and A* segmentations are beyond SQL; the rows are tested against brute force instead.
ORACLE_SQL: str | None = None


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, the failed lines go."""
    judged = quality_rules(docs, with_text=True, carry=True).where("kept")
    cleaned = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[cleaned.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    out = line_dedup(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays. Rows without id stay as they are.

    Rows of one id with different texts are documents of their own; of rows with the same id and text the first stays, by
    its columns as JSON.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().where(F.col("count") > 1).limit(1).count():
        rows = named.select("doc_id", F.struct("*").alias("row"), F.sha2("text", 256).alias("name"))
        once = rows.groupBy("doc_id", "name").agg(F.min_by("row", F.to_json("row")).alias("row"))
        ordered = once.select("doc_id", F.col("row.text").alias("text"), "row", "name").orderBy("doc_id", "name")
        numbered = materialise(ordered.select(F.monotonically_increasing_id().alias("number"), "text", "row"))  # in the order of the ids
        kept = near_dedup(numbered, "number", rules=NEAR).where("kept").select("number")
        chosen = numbered.join(kept, "number", "left_semi").select("row.*")
    else:
        kept = near_dedup(docs, rules=NEAR).where("kept").select("doc_id").distinct()
        chosen = named.join(kept, "doc_id", "left_semi")
    return chosen.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text, and whether decoding them gives the text back."""
    return encode_texts(docs, PIECES).drop("rivals")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", clean_lines),
    ("line_dedup", drop_common_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("segmentation", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
