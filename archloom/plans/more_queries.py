"""Further queries, one for each operator that no other query runs, with the SQL that checks them beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions.text import bilingual, short_name, without_comments
from archloom.operators import advisories, graph, layers, merge, quality, resolve
from archloom.plans import adapter, oracles, queries
from archloom.plans.adapter import tagged
from archloom.sinks import documents
from archloom.sources import files
from archloom.sources.parse import declarations, low_confidence, normalised, parse_files
from archloom.tables import table

S, D = SparkSession, DataFrame
TEXTS = "array<string>"


def _decls(spark: S, d: str) -> D:
    """Parts extend their brand; customers use the vendor of their nation, a supplier by its id, a brand and nobody. Suppliers
    of a nation share a name and a file, so that a vendor is met in the same file, the same namespace, alone, or not at all."""
    none = F.array().cast(TEXTS)

    def rows(df: D, id_, name, namespace, path, refs, supertypes) -> D:
        return df.select(id_.alias("id"), name.alias("name"), namespace.alias("namespace"), path.alias("path"), refs.alias("refs"), supertypes.alias("supertypes"))

    p, c, s = table(spark, d, "part"), table(spark, d, "customer"), table(spark, d, "supplier")
    key = F.col("c_custkey")
    nation = F.col("c_nationkey").cast("string")
    place = F.when(key % 2 == 0, F.concat(F.lit("vendors/"), nation, F.lit(".py"))).otherwise(F.concat(F.lit("sales/"), (key % 7).cast("string"), F.lit(".py")))
    wanted = F.array(F.concat(F.lit("Vendor"), nation, F.lit("()")), F.concat(F.lit("s:"), (key % 5 + 1).cast("string")), F.lit("Nobody"), F.concat(F.lit("x.Brand#"), (key % 25 + 11).cast("string")))
    brands = p.select("p_brand").distinct()
    return (
        rows(brands, F.concat(F.lit("catalog."), "p_brand"), F.col("p_brand"), F.lit("catalog"), F.lit("catalog/brand.py"), none, none)
        .unionByName(rows(p, tagged("p", "p_partkey"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")), F.lit("catalog"), F.concat(F.lit("catalog/part"), (F.col("p_partkey") % 10).cast("string"), F.lit(".py")), none, F.array(F.concat(F.lit("x."), "p_brand", F.lit("<T>")))))
        .unionByName(rows(s, tagged("s", "s_suppkey"), F.concat(F.lit("Vendor"), F.col("s_nationkey").cast("string")), F.concat(F.lit("n"), (F.col("s_suppkey") % 3).cast("string")), F.concat(F.lit("vendors/"), F.col("s_nationkey").cast("string"), F.lit(".py")), none, none))
        .unionByName(rows(c, tagged("c", "c_custkey"), F.concat(F.lit("Customer"), key.cast("string")), F.concat(F.lit("n"), (key % 3).cast("string")), place, wanted, none))
    )


REFERENCES = """
decls AS (
  SELECT DISTINCT 'catalog.' || p_brand AS id, p_brand AS name, 'catalog' AS ns, 'catalog/brand.py' AS path FROM part
  UNION ALL SELECT 'p:' || p_partkey, 'part' || p_partkey, 'catalog', 'catalog/part' || (p_partkey % 10) || '.py' FROM part
  UNION ALL SELECT 's:' || s_suppkey, 'Vendor' || s_nationkey, 'n' || (s_suppkey % 3), 'vendors/' || s_nationkey || '.py' FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'Customer' || c_custkey, 'n' || (c_custkey % 3), CASE WHEN c_custkey % 2 = 0 THEN 'vendors/' || c_nationkey || '.py' ELSE 'sales/' || (c_custkey % 7) || '.py' END FROM customer
),
symbols AS (
  SELECT 'p:' || p_partkey AS id, 'x.' || p_brand || '<T>' AS raw, p_brand AS short, 'extends' AS kind FROM part
  UNION ALL SELECT 'c:' || c_custkey, 'Vendor' || c_nationkey || '()', 'Vendor' || c_nationkey, 'uses' FROM customer
  UNION ALL SELECT 'c:' || c_custkey, 's:' || (c_custkey % 5 + 1), 's:' || (c_custkey % 5 + 1), 'uses' FROM customer
  UNION ALL SELECT 'c:' || c_custkey, 'x.Brand#' || (c_custkey % 25 + 11), 'Brand#' || (c_custkey % 25 + 11), 'uses' FROM customer
),
exact AS (SELECT s.id AS src, s.raw AS dst, kind FROM symbols s SEMI JOIN decls t ON t.id = s.raw),
met AS (
  SELECT s.id AS src, s.raw, s.kind, t.id AS dst, o.path AS src_path, t.path AS dst_path, t.ns AS token, CASE WHEN o.path = t.path THEN 0 WHEN o.ns = t.ns THEN 1 ELSE 2 END AS near
  FROM symbols s JOIN decls o ON o.id = s.id JOIN decls t ON t.name = s.short WHERE s.raw NOT IN (SELECT id FROM decls)
),
best AS (SELECT *, min(near) OVER (PARTITION BY src, raw, kind) AS least FROM met),
one AS (SELECT src, raw, kind, any_value(dst) AS dst, any_value(src_path) AS src_path, any_value(dst_path) AS dst_path, any_value(token) AS token FROM best WHERE near = least GROUP BY src, raw, kind HAVING count(DISTINCT dst) = 1)"""


def reference_edges(spark: S, d: str) -> D:
    """References and supertypes to declarations."""
    return graph.resolve_edges(_decls(spark, d))


def guarded_edges(spark: S, d: str) -> D:
    """The same where files mention namespaces; sales files of even number mention one of three."""
    said = spark.createDataFrame([(f"sales/{i}.py", f"n{i % 3}") for i in range(0, 7, 2)], "path string, token string")
    return graph.resolve_edges(_decls(spark, d), said)


def reference_resolution(spark: S, d: str) -> D:
    """Names of customers' files, bound by imports from one found, one missing and one foreign module."""
    k = F.col("c_custkey")
    name = lambda letter, n: F.concat(F.lit(letter), (k % n).cast("string"))
    decls = table(spark, d, "customer").select(tagged("c", "c_custkey").alias("id"), name("f", 50).alias("path"), name("v", 20).alias("name"), k.alias("line"), F.array(name("v", 7), name("w", 5), name("y", 11)).alias("refs"))
    scopes = spark.createDataFrame([(f"f{i}", f"w{j}", f"./lib{j % 3}", "*" if j == 3 and i % 2 else f"e{j}") for i in range(50) for j in range(5)], "path string, local string, source string, imported string")
    found = spark.createDataFrame([(f"f{i}", f"./lib{j}", "lib0" if j == 0 else None, ("relative", "unresolved", "external")[j]) for i in range(50) for j in range(3)], "path string, source string, file string, via string")
    exports = spark.createDataFrame([("lib0", "e0", "x:e0", True), ("lib0", "e9", "x:e9", False)], "path string, name string, id string, own boolean")
    return resolve.resolve_refs(decls, scopes, found, exports)


def layer_documents(spark: S, d: str) -> D:
    """K2: nations as layers with their suppliers as classes, each one JSON document."""
    nations = table(spark, d, "nation").select(tagged("n", "n_nationkey").alias("id"), F.col("n_nationkey").alias("order"))
    classes = table(spark, d, "supplier").select(tagged("s", "s_suppkey").alias("id"), tagged("n", "s_nationkey").alias("layer"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"))
    return documents.layers_document(nations, classes)


def displayable_flows(spark: S, d: str) -> D:
    """Q8: orders whose pipeline has stages, all of them named, and the first of them."""
    errors = queries.pipeline_validate(spark, d).where("rule in ('stage-name', 'no-stages')").select(F.col("o_orderkey").alias("diagram"))
    return quality.displayable(table(spark, d, "orders").select(F.col("o_orderkey").alias("diagram"), F.col("o_orderkey").alias("ord")), errors).select(F.col("diagram").alias("o_orderkey"), "is_default")


def bilingual_pick(spark: S, d: str) -> D:
    """P15 in both languages over parts with one half, both, a joined text or nothing."""
    size, name = F.col("p_size"), F.col("p_name")
    zh, en = F.when(size % 5 == 0, F.concat(F.lit("漢"), name)), F.when(size % 7 == 0, name).otherwise(F.when(size % 2 == 0, F.lit(" ")))
    joined = F.when(size % 3 == 0, F.concat(F.lit("漢字 · "), name)).when(size % 3 == 1, F.concat(name, F.lit(" / "), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", bilingual(zh, en, joined, "zh").alias("zh"), bilingual(zh, en, joined, "en").alias("en"))


def plain_json(spark: S, d: str) -> D:
    """P17 over parts as commented documents."""
    text = F.concat(F.lit('{"a": "http://x", /* '), "p_name", F.lit(' */ "b": [1, 2,], // '), "p_brand", F.lit('\n  "k": '), F.col("p_partkey").cast("string"), F.lit(",\n}"))
    return table(spark, d, "part").select("p_partkey", without_comments(text).alias("text"))


def _tree(spark: S, d: str) -> D:
    """Pages as files: path, realpath (shared by pages of one address), ord."""
    ending = F.when(F.col("page_id") % 3 == 0, ".py").when(F.col("page_id") % 3 == 1, ".txt").otherwise(".rb")
    folder = F.when(F.col("page_id") % 4 == 0, "build/").when(F.col("page_id") % 4 == 1, "src/test/").otherwise("src/")
    return adapter.page_paths(spark, d).select(F.concat(folder, F.coalesce("path", F.lit("")), F.lit("/f"), F.col("page_id").cast("string"), ending).alias("path"), F.concat(F.lit("/"), "path", ending).alias("realpath"), F.col("page_id").alias("ord"))


def source_scan(spark: S, d: str) -> D:
    """Files that are read, one for each real path, without skipped folders; there is no manifest beside build."""
    return files.scan(_tree(spark, d), files.skip_names(spark)).select("path", "language", F.col("ord").alias("page_id"))


def extension_census(spark: S, d: str) -> D:
    """S2."""
    return files.census(_tree(spark, d))


def latest_change(spark: S, d: str) -> D:
    """A20 over events."""
    return files.latest_change(table(spark, d, "events").select(F.col("ts").alias("modificationTime"))).select(F.unix_micros(F.col("modificationTime").cast("timestamp")).alias("at"))


#: A file of each language with one declaration, and what is read from it: (language, text, name, kind). K stands for a number.
SAMPLES = (
    ("python", "class TK(BK):\n    pass\n", "TK", "class"),
    ("typescript", "export class TK extends BK {\n}\n", "TK", "class"),
    ("go", "package m\n\ntype TK struct {\n}\n", "TK", "struct"),
    ("rust", "pub struct TK {\n}\n", "TK", "struct"),
    ("java", "public class TK extends BK {\n}\n", "TK", "class"),
    ("kotlin", "class TK : BK() {\n}\n", "TK", "class"),
    ("c", "struct TK {\n  int a;\n};\n", "TK", "struct"),
    ("cpp", "class TK : public BK {\n};\n", "TK", "class"),
    ("csharp", "public class TK : BK {\n}\n", "TK", "class"),
    ("swift", "class TK: BK {\n}\n", "TK", "class"),
    ("objc", "@interface TK : BK\n@end\n", "TK", "class"),
    ("lua", "function TK()\nend\n", "TK", "function"),
    ("dart", "class TK extends BK {\n}\n", "TK", "class"),
)


def _samples(spark: S, d: str) -> D:
    rows = spark.createDataFrame([(i, language, text) for i, (language, text, _, _) in enumerate(SAMPLES)], "i int, language string, body string")
    own = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(SAMPLES)).cast("int").alias("i")).join(F.broadcast(rows), "i")
    return own.select(F.concat(F.lit("d/f"), F.col("p_partkey").cast("string"), F.lit(".x")).alias("path"), F.replace("body", F.lit("K"), F.col("p_partkey").cast("string")).alias("content"), "language")


def readers(spark: S, d: str) -> D:
    """Parts as files of thirteen languages."""
    found = declarations(parse_files(_samples(spark, d)))
    return found.select("path", "language", "name", "kind", "line", F.coalesce(F.get("supertypes", F.lit(0)), F.lit("")).alias("base"))


def unclosed_files(spark: S, d: str) -> D:
    """Java files, every third without its last brace."""
    k = F.col("p_partkey")
    body = F.concat(F.lit("class T"), k.cast("string"), F.lit(" {\n  int a;\n"), F.when(k % 3 == 0, "").otherwise("}\n"))
    contents = table(spark, d, "part").select(F.concat(F.lit("f"), k.cast("string"), F.lit(".java")).alias("path"), body.alias("content"), F.lit("java").alias("language"))
    return low_confidence(declarations(parse_files(contents))).select("path", "line", "reason")


def record_defaults(spark: S, d: str) -> D:
    """P12 over customers that lack an id, a path or both."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, F.when(k % 2 == 0, tagged("c", "c_custkey")).otherwise("").alias("id"), F.when(k % 3 == 0, F.concat(F.lit("f"), k.cast("string"))).alias("path"), F.lit("sales").alias("namespace"), F.col("c_name").alias("name"), F.when(k % 5 == 0, F.col("c_acctbal")).alias("importance"))
    return normalised(rows).select("c_custkey", "id", "importance", "in_degree", "out_degree")


def repeated_ids(spark: S, d: str) -> D:
    """Customers with several orders."""
    return quality.duplicate_ids(table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("id"))).withColumnRenamed("id", "o_custkey")


def unmet_expectations(spark: S, d: str) -> D:
    """Customers without an urgent order, by their key."""
    expected = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return quality.missing(expected, table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def violation_report(spark: S, d: str) -> D:
    """Q6, K9: two checks as one report."""
    return quality.violations(repeated=repeated_ids(spark, d).select(F.col("o_custkey").alias("subject")), unmet=unmet_expectations(spark, d).select(F.col("c_custkey").alias("subject")))


def row_packing(spark: S, d: str) -> D:
    """Suppliers as boxes in the rows of their nation."""
    s = table(spark, d, "supplier")
    boxes = s.select(F.col("s_nationkey").alias("layer"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 7 + 1) * 10.0).alias("w"))
    return layers.pack_rows(boxes, 100.0, 5.0).select(F.col("layer").alias("s_nationkey"), F.col("id").alias("s_suppkey"), F.col("row").cast("long").alias("row"))


def importance_order(spark: S, d: str) -> D:
    """Places of nodes in their layers."""
    return layers.by_importance(queries._scored(spark, d).withColumn("importance", F.round("importance", 6))).select("layer", "id", F.col("ord").cast("long").alias("ord"))


def evidence_top3(spark: S, d: str) -> D:
    """W13."""
    return layers.top_evidence(queries.template_score(spark, d))


def core_only_layers(spark: S, d: str) -> D:
    """Layers that hold core rows, with how many."""
    classes = queries.core_per_layer(spark, d)
    some, kept = layers.core_view(classes, classes.select(F.col("layer").alias("id")).distinct())
    return kept.join(some.groupBy(F.col("layer").alias("id")).agg(F.count("*").alias("n")), "id")


def own_package_roots(spark: S, d: str) -> D:
    """Parts as build files."""
    brand, size = F.replace("p_brand", F.lit("#"), F.lit("_")), F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(F.lit('namespace = "com.'), brand, F.lit('.x"\napplicationId = "org.app'), (size % 4).cast("string"), F.lit('"'))).when(size % 3 == 1, F.concat(F.lit("<groupId> net.y"), size.cast("string"), F.lit(".z </groupId><groupId>skip.me</groupId>"))).otherwise(F.lit("none"))
    return advisories.own_roots(table(spark, d, "part").select(text.alias("text")), spark.createDataFrame([("never.used",)], "namespace string"))


def all_advisories(spark: S, d: str) -> D:
    """T7."""
    return advisories.advisories(queries.vendored_dirs(spark, d), queries.dominant_unsupported(spark, d))


def skip_set(spark: S, d: str) -> D:
    """Parts as the lines of a skip list."""
    k, size = F.col("p_partkey"), F.col("p_size") % 4
    line = F.when(size == 0, F.concat(F.lit("  dir"), (k % 20).cast("string"), F.lit(" "))).when(size == 1, F.concat(F.lit("-dir"), (k % 20).cast("string"))).when(size == 2, F.lit("# dir99")).otherwise(F.concat(F.lit("dir"), (k % 15).cast("string"), F.lit("#x # note")))
    return merge.last_wins(table(spark, d, "part").select(k.cast("int").alias("ord"), line.alias("line")), ["dir1", "base"])


def once_per_id(spark: S, d: str) -> D:
    """T5: a customer's first order of each priority; orders without customer all stay."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("id"))
    return merge.once_per_id(rows, ["o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "id")


def overlay_remove(spark: S, d: str) -> D:
    """M9: entries less those of some users."""
    entries = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id")
    return merge.without_entries(entries, table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))).select("event_id")


def open_work(spark: S, d: str) -> D:
    """A19."""
    return merge.work_counts(queries.incremental_merge(spark, d), queries.flow_merge(spark, d))


def class_index(spark: S, d: str) -> D:
    """A customer's last order stands for it."""
    return layers.latest_per(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.desc("o_orderkey")])


def short_names(spark: S, d: str) -> D:
    """Tails of the links of pages."""
    return adapter.page_links(spark, d).select("page_id", "at", short_name(F.col("href")).alias("tail"))


QUERIES = {
    f.__name__: f
    for f in (
        reference_edges, guarded_edges, reference_resolution, layer_documents, displayable_flows, bilingual_pick, plain_json, source_scan, extension_census, latest_change, readers, unclosed_files,
        record_defaults, repeated_ids, unmet_expectations, violation_report, row_packing, importance_order, evidence_top3, core_only_layers, own_package_roots, all_advisories, skip_set, once_per_id,
        overlay_remove, open_work, class_index, short_names,
    )
}

TREE = f"""
{oracles.PATHS},
tree AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'build/' WHEN 1 THEN 'src/test/' ELSE 'src/' END || path || '/f' || page_id || e AS path, '/' || path || e AS realpath, e
  FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.txt' ELSE '.rb' END AS e FROM paths)
)"""
REPEATED = "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY o_custkey HAVING count(*) > 1"
UNMET = "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')"
KINDS = ", ".join(f"({i}, '{language}', '{name}', '{kind}', {1 + text[: text.index(name)].count(chr(10))}, '{'BK' if 'BK' in text else ''}')" for i, (language, text, name, kind) in enumerate(SAMPLES))
SIGNS = "漢"

ORACLES = {
    "reference_edges": f"WITH {REFERENCES} SELECT * FROM exact UNION SELECT src, dst, kind FROM one WHERE src <> dst",
    "guarded_edges": f"""WITH {REFERENCES}, said AS (SELECT 'sales/' || i || '.py' AS path, 'n' || (i % 3) AS token FROM (VALUES (0), (2), (4), (6)) AS t(i))
      SELECT * FROM exact UNION SELECT src, dst, kind FROM one WHERE src <> dst AND (kind = 'extends' OR src_path = dst_path OR EXISTS (SELECT 1 FROM said WHERE said.path = one.src_path AND said.token = one.token))""",
    "reference_resolution": """WITH d AS (SELECT 'c:' || c_custkey AS id, 'f' || (c_custkey % 50) AS path, c_custkey % 50 AS f, 'v' || (c_custkey % 20) AS name, c_custkey AS k FROM customer),
      own AS (SELECT path, name, arg_min(id, k) AS own_id FROM d GROUP BY path, name),
      refs AS (SELECT id AS src, path, f, 'v' || (k % 7) AS raw, NULL AS j FROM d UNION ALL SELECT id, path, f, 'w' || (k % 5), k % 5 FROM d),
      r AS (
        SELECT src, raw, own_id AS dst, 'same-file' AS via, NULL AS reason FROM refs JOIN own ON own.path = refs.path AND own.name = refs.raw
        UNION ALL SELECT src, raw, CASE WHEN j = 0 THEN 'x:e0' END, CASE WHEN j = 0 THEN 'import' END,
          CASE WHEN (j = 3 AND f % 2 = 1) OR j = 2 THEN 'external' WHEN j % 3 = 1 THEN 'unresolved_specifier' WHEN j = 3 THEN 'not_exported' END
        FROM refs WHERE raw LIKE 'w%'
      ) SELECT * FROM r WHERE reason IS NOT NULL OR dst <> src""",
    "layer_documents": """WITH c AS (SELECT s_nationkey AS k, string_agg('{"id":"s:' || s_suppkey || '"' || CASE WHEN s_suppkey % 3 <> 0 THEN ',"name":"' || s_name || '"' ELSE '' END || '}', ',' ORDER BY 's:' || s_suppkey) AS t FROM supplier GROUP BY 1)
      SELECT 'n:' || n_nationkey AS id, '{"id":"n:' || n_nationkey || '","order":' || n_nationkey || ',"classes":[' || coalesce(t, '') || ']}' AS doc FROM nation LEFT JOIN c ON k = n_nationkey""",
    "displayable_flows": f"""WITH bad AS (SELECT * FROM ({oracles.ORACLES["pipeline_validate"]}) WHERE rule IN ('stage-name', 'no-stages')), good AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM bad))
      SELECT o_orderkey, o_orderkey = (SELECT min(o_orderkey) FROM good) AS is_default FROM good""",
    "bilingual_pick": f"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '{SIGNS}' || p_name WHEN p_size % 7 = 0 THEN p_name WHEN p_size % 3 = 0 THEN '漢字' WHEN p_size % 3 = 1 THEN p_name || ' / ' || p_brand ELSE '' END AS zh,
      CASE WHEN p_size % 7 = 0 THEN p_name WHEN p_size % 5 = 0 THEN '{SIGNS}' || p_name WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_name || ' / ' || p_brand ELSE '' END AS en FROM part""",
    "plain_json": """SELECT p_partkey, '{"a": "http://x",  "b": [1, 2], ' || chr(10) || '  "k": ' || p_partkey || chr(10) || '}' AS text FROM part""",
    "source_scan": f"""WITH {TREE} SELECT arg_min(path, page_id) AS path, 'python' AS language, min(page_id) AS page_id FROM tree WHERE e = '.py' AND NOT regexp_matches(path, '(^|/)test/') GROUP BY realpath""",
    "extension_census": "SELECT CASE page_id % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'txt' ELSE 'rb' END AS ext, count(*) AS n FROM pages GROUP BY 1",
    "latest_change": "SELECT epoch_us(max(ts)) AS at FROM events",
    "readers": f"""WITH k AS (SELECT * FROM (VALUES {KINDS}) AS t(i, language, name, kind, line, base))
      SELECT 'd/f' || p_partkey || '.x' AS path, language, replace(name, 'K', CAST(p_partkey AS VARCHAR)) AS name, kind, line, replace(base, 'K', CAST(p_partkey AS VARCHAR)) AS base FROM part JOIN k ON i = p_partkey % {len(SAMPLES)}""",
    "unclosed_files": "SELECT 'f' || p_partkey || '.java' AS path, 1 AS line, 'low-confidence' AS reason FROM part WHERE p_partkey % 3 = 0",
    "record_defaults": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'c:' || c_custkey WHEN c_custkey % 3 = 0 THEN 'f' || c_custkey ELSE 'sales.' || c_name END AS id,
      CASE WHEN c_custkey % 5 = 0 THEN c_acctbal ELSE 0.0 END AS importance, 0 AS in_degree, 0 AS out_degree FROM customer""",
    "repeated_ids": REPEATED,
    "unmet_expectations": UNMET,
    "violation_report": f"SELECT 'repeated' AS rule, CAST(o_custkey AS VARCHAR) AS subject FROM ({REPEATED}) UNION ALL SELECT 'unmet', CAST(c_custkey AS VARCHAR) FROM ({UNMET})",
    "row_packing": """WITH RECURSIVE b AS (SELECT s_nationkey, s_suppkey, (s_suppkey % 7 + 1) * 10.0 AS w, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
      f AS (
        SELECT s_nationkey, s_suppkey, i, CAST(0 AS BIGINT) AS row, CAST(w AS DOUBLE) AS used FROM b WHERE i = 1
        UNION ALL SELECT b.s_nationkey, b.s_suppkey, b.i, CASE WHEN used + 5 + w <= 100 THEN row ELSE row + 1 END, CASE WHEN used + 5 + w <= 100 THEN used + 5 + w ELSE w END FROM f JOIN b ON b.s_nationkey = f.s_nationkey AND b.i = f.i + 1
      ) SELECT s_nationkey, s_suppkey, row FROM f""",
    "importance_order": f"WITH {oracles.G},{oracles.SCORED} SELECT layer, id, row_number() OVER (PARTITION BY layer ORDER BY importance DESC, id) AS ord FROM scored",
    "evidence_top3": f"WITH {oracles.TEMPLATES} SELECT template, score FROM scores ORDER BY score DESC, template LIMIT 3",
    "core_only_layers": f"SELECT layer AS id, count(*) AS n FROM ({oracles.ORACLES['core_per_layer']}) WHERE core GROUP BY layer",
    "own_package_roots": """SELECT DISTINCT root FROM (
      SELECT 'com.' || replace(p_brand, '#', '_') AS root FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'org.app' || (p_size % 4) FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'net.y' || p_size FROM part WHERE p_size % 3 = 1)""",
    "all_advisories": f"""SELECT 'vendored-dir' AS kind, dir, n AS declarations, "foreign", round_even("foreign" * 100.0::DOUBLE / n, 1) AS foreign_pct, root AS dominant_foreign, NULL AS language, NULL AS files FROM ({oracles.ORACLES["vendored_dirs"]})
      UNION ALL SELECT 'unsupported-dominant-language', NULL, NULL, NULL, NULL, NULL, language, files FROM ({oracles.ORACLES["dominant_unsupported"]})""",
    "skip_set": """WITH l AS (SELECT p_partkey AS ord, CASE p_size % 4 WHEN 3 THEN 'dir' || (p_partkey % 15) || '#x' ELSE 'dir' || (p_partkey % 20) END AS name, p_size % 4 <> 1 AS keep FROM part WHERE p_size % 4 <> 2 UNION ALL VALUES (-1, 'dir1', true), (-1, 'base', true))
      SELECT name FROM l GROUP BY name HAVING arg_max(keep, ord)""",
    "once_per_id": """SELECT min(o_orderkey) AS o_orderkey, o_custkey AS id FROM orders WHERE o_orderkey % 10 <> 0 AND o_custkey IS NOT NULL GROUP BY o_orderpriority, o_custkey
      UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 10 = 0 OR o_custkey IS NULL""",
    "overlay_remove": "SELECT event_id FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)",
    "open_work": f"SELECT (SELECT count(*) FROM ({oracles.ORACLES['incremental_merge']}) WHERE stale) AS stale, (SELECT count(*) FROM ({oracles.ORACLES['flow_merge']}) WHERE needs_review) AS needs_review",
    "class_index": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "short_names": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS n FROM pages)
      SELECT page_id, CAST(n AS INTEGER) AS "at", nullif(list_extract(regexp_split_to_array(regexp_replace(href, '[<(][\\s\\S]*$', ''), '\\.|::|/'), -1), '') AS tail FROM l""",
}
