"""Files to declaration, import, re-export and skipped tables, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.functions.text import filled, qualified_name
from archloom.operators import resolve
from archloom.sources.scanner import as_rows, parse

S, I = T.StringType(), T.IntegerType()
PAIRS = T.ArrayType(T.StructType([T.StructField("local", S), T.StructField("imported", S)]))
DECLARATION = T.StructType([
    T.StructField("name", S), T.StructField("namespace", S), T.StructField("kind", S), T.StructField("path", S), T.StructField("line", I), T.StructField("language", S),
    T.StructField("supertypes", T.ArrayType(S)), T.StructField("refs", T.ArrayType(S)), T.StructField("confidence", S), T.StructField("visibility", S), T.StructField("tags", T.ArrayType(S)),
    T.StructField("loc", I), T.StructField("signature", S), T.StructField("method_count", I),
])
IMPORT = T.StructType([T.StructField("raw", S), T.StructField("qualified", S), T.StructField("alias", S), T.StructField("bindings", PAIRS)])
REEXPORT = T.StructType([T.StructField("source", S), T.StructField("star", T.BooleanType()), T.StructField("alias", S), T.StructField("names", PAIRS)])
SKIPPED = T.StructType([T.StructField("line", I), T.StructField("reason", S)])
PARSED = T.StructType([T.StructField("path", S), T.StructField("declarations", T.ArrayType(DECLARATION)), T.StructField("imports", T.ArrayType(IMPORT)), T.StructField("reexports", T.ArrayType(REEXPORT)), T.StructField("skipped", T.ArrayType(SKIPPED))])


def parse_files(files: DataFrame) -> DataFrame:
    """One row a file (path, content, language) with all that was read from it; a file that can't be read has a skipped
    entry. Repeated paths give a row each, null contents count as empty."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [as_rows(parse(c or "", p or "", lang or "")) for p, c, lang in zip(part["path"], part["content"], part["language"], strict=True)]
            yield pd.DataFrame({"path": part["path"], **{k: [f[k] for f in found] for k in ("declarations", "imports", "reexports", "skipped")}})

    return files.select("path", "content", "language").mapInPandas(read, PARSED)


def declarations(parsed: DataFrame) -> DataFrame:
    """Declaration rows with their id."""
    rows = parsed.select(F.explode("declarations").alias("d")).select("d.*")
    return rows.withColumn("id", qualified_name(F.col("namespace"), F.col("name")))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("imports").alias("pos", "i")).select("path", "pos", "i.*")


def reexports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("reexports").alias("pos", "r")).select("path", "pos", "r.*")


def skipped(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("skipped").alias("s")).select("path", "s.*")


def low_confidence(decls: DataFrame) -> DataFrame:
    """P9."""
    return decls.where(F.col("confidence") != "high").select("id", "path", "line", F.lit("low-confidence").alias("reason"))


def normalised(records: DataFrame) -> DataFrame:
    """Records of any origin with the fields that later steps expect. A missing id comes from path, else names."""
    names = qualified_name(F.col("namespace"), F.col("name"))
    default = {"importance": F.lit(0.0), "in_degree": F.lit(0), "out_degree": F.lit(0)}
    out = records.withColumn("id", F.coalesce(filled(F.col("id")), filled(F.col("path")), filled(names)))
    for column, value in default.items():
        out = out.withColumn(column, F.coalesce(F.col(column), value) if column in records.columns else value)
    return out


def resolved_typescript(parsed: DataFrame, aliases: DataFrame | None = None, base_url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolved references, declarations whose refs are ids where they could be resolved) of one project's files."""
    decls = declarations(parsed).where(F.col("language") == "typescript")
    files = parsed.select("path")
    bound = imports(parsed)
    scopes = resolve.import_scopes(bound)
    again = reexports(parsed)
    wanted = scopes.select("path", "source").unionByName(again.select("path", "source"))
    found = resolve.resolve_specifiers(wanted, files, aliases, base_url)
    exported = resolve.export_maps(decls, again.join(found.select("path", "source", "file"), ["path", "source"], "left"))
    refs = resolve.resolve_refs(decls, scopes, found, exported)
    own = refs.where(F.col("dst").isNotNull()).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("_r"))
    rewritten = decls.join(own, "id", "left").withColumn("refs", F.coalesce("_r", F.array().cast("array<string>"))).drop("_r")
    return refs, rewritten
