"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.llm.common import table
from archloom.llm.decontamination import decontaminate
from archloom.llm.line_dedup import line_dedup
from archloom.llm.near_dedup import near_dedup
from archloom.llm.pii import find_pii
from archloom.llm.quality_model import quality_model
from archloom.llm.quality_rules import quality_rules
from archloom.llm.segmentation import encode_texts
from archloom.llm.substring_dedup import substring_dedup
from archloom.llm.suffix_dedup import suffix_dedup
from archloom.llm.token_counts import token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("redacted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(table(spark, sf_dir, "documents"), PIECES, with_ids=False)
    losses = F.array_join(F.transform("rivals", lambda r: F.concat_ws(" ", r["loss"].cast("long").cast("string"), r["edits"])), "|")
    return found.select("doc_id", "n_pieces", "score", "ids_sha256", F.size("rivals").cast("long").alias("n_rivals"), F.sha2(losses, 256).alias("rivals_sha256"), "round_trip")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECES)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_decontamination, op3_line_dedup, op4_segmentation, op5_token_counts, op6_quality_model, op7_near_dedup, op8_suffix_dedup, op9_quality_rules, op10_substring_dedup)}
