"""Reports on a corpus of declarations and files: histograms, vendored folders, unsupported languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archloom.config import TYPE_KINDS
from archloom.functions.text import filled, package_root


def language_counts(rows: DataFrame) -> DataFrame:
    """A3: (language, n), without empty languages."""
    return rows.where(filled(F.col("language")).isNotNull()).groupBy("language").agg(F.count("*").alias("n"))


def namespace_histogram(decls: DataFrame) -> DataFrame:
    """A4: (namespace, n), (none) for none."""
    return decls.groupBy(F.coalesce(filled(F.col("namespace")), F.lit("(none)")).alias("namespace")).agg(F.count("*").alias("n"))


def own_roots(manifests: DataFrame, entry_namespaces: DataFrame) -> DataFrame:
    """(root): package roots named by manifests (text); if there are none, those of the entry points."""
    named = manifests.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(r"\b(?:namespace|applicationId)\s*=\s*[\"']([A-Za-z0-9_.]+)[\"']"), F.lit(1)), F.array(F.regexp_extract("text", r"<groupId>\s*([A-Za-z0-9_.]+)\s*</groupId>", 1)))).alias("ns"))
    named = named.select(package_root(F.col("ns")).alias("root")).where("root <> ''").distinct()
    some = named.agg((F.count("*") > 0).alias("some"))
    fallback = entry_namespaces.select(package_root(F.col("namespace")).alias("root")).where("root <> ''").distinct().crossJoin(F.broadcast(some)).where("not some").select("root")
    return named.unionByName(fallback)


def vendored(decls: DataFrame, roots: DataFrame, least: int = 50, share: float = 0.8) -> DataFrame:
    """(dir, n, foreign, root): top folders mostly of foreign package roots, with the commonest (first seen of equals).

    decls: dir, root, ord. Without own roots nothing can be told and no row comes.
    """
    known = roots.select("root", F.lit(True).alias("own")).distinct()
    some = known.agg((F.count("*") > 0).alias("some"))
    joined = decls.join(F.broadcast(known), "root", "left").withColumn("foreign", F.col("own").isNull())
    sums = joined.groupBy("dir").agg(F.count("*").alias("n"), F.count_if("foreign").alias("foreign"))
    common = joined.where("foreign").groupBy("dir", "root").agg(F.count("*").alias("c"), F.min("ord").alias("first")).groupBy("dir").agg(F.max_by("root", F.struct("c", -F.col("first"))).alias("root"))
    return sums.where((F.col("n") >= least) & (F.col("foreign") / F.col("n") >= share)).join(common, "dir").crossJoin(F.broadcast(some)).where("some").drop("some")


def dominant_unsupported(extensions: DataFrame, languages: DataFrame, supported: DataFrame) -> DataFrame:
    """(language, files) of the largest unsupported language if it has more files than all supported ones.

    extensions: ext, n; languages: ext, language of what isn't supported; supported: one row n.
    """
    sums = extensions.join(F.broadcast(languages), "ext").groupBy("language").agg(F.sum("n").cast("long").alias("files"))
    return sums.orderBy(F.desc("files"), "language").limit(1).crossJoin(supported.select(F.col("n").alias("_s"))).where(F.col("files") > F.col("_s")).drop("_s")


def kind_counts(decls: DataFrame, by: str = "layer") -> DataFrame:
    """Types and the rest."""
    is_type = F.col("kind").isin(*TYPE_KINDS)
    return decls.groupBy(by).agg(F.count_if(is_type).alias("types"), F.count_if(~is_type).alias("functions"))


def shares(counts: DataFrame, column: str = "n") -> DataFrame:
    """Adds share of the whole, to three digits."""
    return counts.withColumn("share", F.round(F.col(column) / F.sum(column).over(W.partitionBy(F.lit(1))), 3))


def advisories(vendored_dirs: DataFrame, unsupported: DataFrame) -> DataFrame:
    """The advisories of a project in one table, those on folders first (largest first), then that on its language."""
    folders = vendored_dirs.select(F.lit("vendored-dir").alias("kind"), "dir", F.col("n").alias("declarations"), "foreign", F.bround(F.col("foreign") * 100.0 / F.col("n"), 1).alias("foreign_pct"), F.col("root").alias("dominant_foreign"))
    language = unsupported.select(F.lit("unsupported-dominant-language").alias("kind"), "language", "files")
    return folders.unionByName(language, allowMissingColumns=True).orderBy(F.col("dir").isNull(), F.desc("declarations"), "dir")
