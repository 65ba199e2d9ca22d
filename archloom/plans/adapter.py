"""The star schema seen as a declaration graph, so that the operators run on tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.tables import table


def tagged(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers use the parts they ordered, parts their suppliers; suppliers extend nations, nations regions."""
    items = table(spark, sf_dir, "lineitem")
    bought = items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(tagged("c", "o_custkey").alias("src"), tagged("p", "l_partkey").alias("dst")).distinct()
    made = items.select(tagged("p", "l_partkey").alias("src"), tagged("s", "l_suppkey").alias("dst")).distinct()
    based = table(spark, sf_dir, "supplier").select(tagged("s", "s_suppkey").alias("src"), tagged("n", "s_nationkey").alias("dst"))
    within = table(spark, sf_dir, "nation").select(tagged("n", "n_nationkey").alias("src"), tagged("r", "n_regionkey").alias("dst"))
    uses = bought.unionByName(made).withColumn("kind", F.lit("uses"))
    return uses.unionByName(based.unionByName(within).withColumn("kind", F.lit("extends")))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, layer, visibility, supertypes, refs, namespace, kind of every row of the five tables."""
    none = F.array().cast("array<string>")

    def nodes(name: str, prefix: str, key: str, label: str, layer: Column, visibility: Column, supertypes: Column, refs: Column, namespace: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            tagged(prefix, key).alias("id"), F.col(label).alias("name"), layer.alias("layer"), visibility.alias("visibility"), supertypes.alias("supertypes"),
            refs.alias("refs"), namespace.alias("namespace"), F.lit("class" if prefix == "p" else "function").alias("kind"),
        )

    public = F.lit("public")
    hidden = F.when(F.col("p_size") % 5 == 0, "private").otherwise("public")
    brand = F.array(F.concat(F.lit("catalog."), F.col("p_brand"), F.lit("<T>")))
    wanted = F.array(F.concat(F.lit("Brand#"), (F.col("c_custkey") % 25 + 1).cast("string"), F.lit("()")))
    return (
        nodes("part", "p", "p_partkey", "p_name", F.col("p_type"), hidden, brand, none, F.concat_ws(".", F.lit("catalog"), "p_type", "p_brand"))
        .unionByName(nodes("customer", "c", "c_custkey", "c_name", F.col("c_mktsegment"), public, none, wanted, F.concat_ws(".", F.lit("sales"), "c_mktsegment")))
        .unionByName(nodes("supplier", "s", "s_suppkey", "s_name", F.lit("supply"), public, none, none, F.lit("supply")))
        .unionByName(nodes("nation", "n", "n_nationkey", "n_name", F.lit("uncategorized"), public, none, none, F.lit("geo")))
        .unionByName(nodes("region", "r", "r_regionkey", "r_name", F.lit("uncategorized"), public, none, none, F.lit("geo")))
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and the path of each page's address, without host, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, at, href: links of each page in order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("at", "href"))


#: Layer rules over page paths: (layer, layer_pos, segments, suffixes).
LAYERS = (("english", 0, ("en",), ("html",)), ("romance", 1, ("fr", "es"), ("1", "3")), ("german", 2, ("de",), ("5", "7")))
#: Template signals over pages: (template, kind, match, weight).
SIGNALS = (
    ("clean-architecture", "path", "en", 2), ("clean-architecture", "dependency", "track(1)", 1), ("layered", "path", "fr", 3), ("layered", "dependency", "charset", 2),
    ("mvc", "path", "de", 1), ("mvc", "file", "1?", 1), ("pipeline", "path", "none", 5), ("pipeline", "file", "*7", 1),
)


def segment_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, p, s) for n, p, ss, _ in LAYERS for s in ss], "layer string, layer_pos int, segment string")


def suffix_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, p, s) for n, p, _, ss in LAYERS for s in ss], "layer string, layer_pos int, suffix string")


def signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNALS, "template string, kind string, match string, weight int")
