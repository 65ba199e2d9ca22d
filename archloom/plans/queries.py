"""One query for each operator or group of operators, over the adapter's view of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archloom.config import DEFAULT
from archloom.functions.text import display_units, identifiers, is_entry_point, module_token, package_root, porcelain_path, qualified_name, repository_name, short_name
from archloom.operators import advisories, flows, graph, labels, layers, merge, quality, resolve
from archloom.plans import adapter
from archloom.plans.adapter import tagged
from archloom.sinks import mermaid
from archloom.tables import saved, table

S, D = SparkSession, DataFrame


def graph_edges(spark: S, d: str) -> D:
    return adapter.graph_edges(spark, d)


def node_degrees(spark: S, d: str) -> D:
    return graph.degrees(adapter.graph_nodes(spark, d), adapter.graph_edges(spark, d))


def _scored(spark: S, d: str, edges: D | None = None) -> D:
    nodes = adapter.graph_nodes(spark, d)
    found = graph.degrees(nodes, adapter.graph_edges(spark, d) if edges is None else edges).join(nodes.hint("merge"), "id")
    return graph.importance(saved(found), digits=None)  # read twice: for the maxima and for the rows


def importance(spark: S, d: str) -> D:
    return _scored(spark, d).select("id", F.round("importance", 6).alias("importance"))


def hub_topk(spark: S, d: str) -> D:
    return graph.hubs(saved(node_degrees(spark, d))).select("id", "in_degree")


def core_per_layer(spark: S, d: str) -> D:
    return graph.core(_scored(spark, d).drop("name").withColumn("importance", F.round("importance", 6))).select("layer", "id", "core")


def dispatch_index(spark: S, d: str) -> D:
    decls = _scored(spark, d).withColumn("importance", F.round("importance", 6))
    return graph.capped(graph.dispatch_index(decls)).select("key", "impl", F.col("rank").cast("long").alias("rank"), F.col("omitted").cast("long").alias("omitted"))


def _known(spark: S, d: str) -> tuple[D, D, D]:
    """Scored nodes with hub flag, edges, hub ids, each written once."""
    edges = saved(adapter.graph_edges(spark, d))
    scored = _scored(spark, d, edges).withColumn("importance", F.round("importance", 6))
    hub = saved(graph.hubs(scored).select("id"))
    flagged = scored.join(hub.withColumn("hub", F.lit(True)), "id", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    return saved(flagged), edges, hub


def flow_seeds(spark: S, d: str) -> D:
    return flows.select_seeds(_known(spark, d)[0])


def flow_reach(spark: S, d: str) -> D:
    """What every customer reaches over edges of either kind."""
    edges = saved(adapter.graph_edges(spark, d))
    hub = saved(graph.hubs(saved(graph.degrees(adapter.graph_nodes(spark, d), edges))).select("id"))
    seeds = table(spark, d, "customer").select(tagged("c", "c_custkey").alias("id"))
    return flows.reach(seeds, edges, hub, DEFAULT.max_depth)


def flow_trace(spark: S, d: str) -> D:
    decls, edges, hub = _known(spark, d)
    index = saved(graph.dispatch_index(decls))
    return flows.trace_flows(flows.select_seeds(decls), decls, edges, hub, index, decls.select("id", "refs"))


def dispatch_flows(spark: S, d: str) -> D:
    decls, edges, hub = _known(spark, d)
    found = flows.dispatch_flows(decls, saved(graph.dispatch_index(decls)), edges, hub)
    return found.select("key", "root", "src", "dst", "kind", F.col("omitted").cast("long").alias("omitted"))


def flow_subset_suppress(spark: S, d: str) -> D:
    """Orders as flows over their parts."""
    return flows.suppress_contained(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("flow"), F.col("l_orderkey").alias("ord"), F.col("l_partkey").alias("node"))).select(F.col("flow").alias("o_orderkey"))


def layer_assign(spark: S, d: str) -> D:
    pages = adapter.page_paths(spark, d).select(F.col("page_id").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.lit(None).cast("string").alias("namespace"))
    return layers.assign_layers(pages, adapter.segment_rules(spark), adapter.suffix_rules(spark)).select(F.col("id").alias("page_id"), "layer")


def layer_fit(spark: S, d: str) -> D:
    found = layer_assign(spark, d)
    names = spark.createDataFrame([(n,) for n, *_ in adapter.LAYERS] + [("unused",), ("uncategorized",)], "id string")
    return layers.template_fit(found, names)


def group_order(spark: S, d: str) -> D:
    """Regions as groups of their nations, those of even key as rows."""
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("children"))
    config = table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    layout = F.when(F.col("r_regionkey") % 2 == 0, "row").otherwise("column")
    found = layers.expand_groups(config.select(F.col("r_name").alias("id"), F.col("r_regionkey").alias("pos"), F.lit(None).cast("double").alias("order"), layout.alias("layout"), "children"))
    return found.select("id", F.round("order", 6).alias("layer_order"), "grp")


def template_score(spark: S, d: str) -> D:
    paths = adapter.page_paths(spark, d)
    texts = table(spark, d, "pages").select(F.col("html").alias("text"))
    return layers.template_scores(paths.select("path"), texts, layers.directory_closure(paths), adapter.signals(spark)).select("template", F.col("score").cast("long").alias("score"))


def template_choice(spark: S, d: str) -> D:
    return layers.choose_template(template_score(spark, d))


def language_histogram(spark: S, d: str) -> D:
    return advisories.shares(advisories.language_counts(table(spark, d, "documents").withColumnRenamed("lang", "language")))


def namespace_histogram(spark: S, d: str) -> D:
    size = F.when(F.col("p_size") > 45, "").otherwise(F.concat_ws(".", F.lit("catalog"), "p_type", "p_brand"))
    return advisories.namespace_histogram(table(spark, d, "part").select(size.alias("namespace")))


def vendored_dirs(spark: S, d: str) -> D:
    """Sources as folders; documents in French or English as the project's own."""
    docs = table(spark, d, "documents").select(F.col("source").alias("dir"), F.col("lang").alias("root"), F.col("doc_id").alias("ord"))
    own = spark.createDataFrame([("fr",), ("en",)], "root string")
    return advisories.vendored(docs, own, 5, 0.1)


def dominant_unsupported(spark: S, d: str) -> D:
    counts = table(spark, d, "documents").groupBy(F.col("lang").alias("ext")).agg(F.count("*").alias("n"))
    other = spark.createDataFrame([("de", "germanic"), ("en", "germanic"), ("es", "iberian")], "ext string, language string")
    return advisories.dominant_unsupported(counts, other, counts.where("ext = 'fr'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def token_mentions(spark: S, d: str) -> D:
    """How many documents mention each identifier."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return graph.mentions_of(docs).groupBy("token").agg(F.count("*").alias("n_docs"))


def false_edge_guard(spark: S, d: str) -> D:
    """Of the edges from every document to every benchmark item, those where the document says the item's token (its
    first identifier). Documents are reduced to the tokens that some item has before they meet the items."""
    docs = table(spark, d, "documents")
    items = table(spark, d, "benchmark").select("item_id", F.get(identifiers(F.col("text")), F.lit(0)).alias("token")).where("token is not null")
    said = graph.mentions_of(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))).join(items.select("token").distinct(), "token", "left_semi")
    return said.join(items, "token").select(F.col("path").alias("doc_id"), "item_id")


def name_functions(spark: S, d: str) -> D:
    """P2-P4, P7, P18, S15 over parts."""
    p = table(spark, d, "part")
    ns = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat_ws(".", F.lit("catalog"), "p_type", "p_brand"))
    raw = F.concat(F.lit("a.b::"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("<T>(x)"))
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py"))
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("R  old -> "), path)).otherwise(F.concat(F.lit(' M "'), path, F.lit('"')))
    return p.select(
        "p_partkey", qualified_name(ns, F.col("p_name")).alias("qname"), short_name(raw).alias("short"), module_token(ns, path).alias("module"), package_root(F.nullif(ns, F.lit(""))).alias("root"),
        porcelain_path(line).alias("changed"), repository_name(F.concat(F.lit("https://host.example/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".git/"))).alias("repo"), is_entry_point(F.col("p_name")).alias("entry"),
    )


def import_edges(spark: S, d: str) -> D:
    """First link of each page to a name."""
    links = adapter.page_links(spark, d)
    local = F.element_at(F.split("href", "[/.]"), -1)
    imports = links.select(F.col("page_id").alias("path"), F.col("at").alias("pos"), F.col("href").alias("raw"), F.array(F.struct(F.lower(local).alias("local"), local.alias("imported"))).alias("bindings"))
    return resolve.import_scopes(imports).select(F.col("path").alias("page_id"), "local", F.col("source").alias("href"))


def _specifiers(spark: S, d: str) -> D:
    paths = adapter.page_paths(spark, d)
    n = F.regexp_extract("path", "([0-9]+)$", 1).try_cast("int")
    wanted = paths.select("path", F.when(n % 3 == 0, F.concat(F.lit("./"), (n + 1).cast("string"))).when(n % 3 == 1, F.concat(F.lit("@/en/"), n.cast("string"))).otherwise(F.concat(F.lit("lib"), (n % 10).cast("string"))).alias("source"))
    files = paths.select(F.concat("path", F.when(F.col("page_id") % 2 == 0, ".ts").otherwise("/index.js")).alias("path"))
    aliases = spark.createDataFrame([("@/*", "*", 0, 0), ("lib1", "en/1", 1, 0)], "pattern string, target string, pattern_pos int, target_pos int")
    return resolve.resolve_specifiers(wanted.where("source is not null"), files, aliases)


def specifier_resolve(spark: S, d: str) -> D:
    return _specifiers(spark, d)


def resolution_coverage(spark: S, d: str) -> D:
    found = _specifiers(spark, d)
    reason = F.when(F.col("via").isin("external", "unresolved"), F.col("via"))
    return resolve.resolution_stats(found.select(F.col("file").alias("dst"), "via", reason.alias("reason")))


def export_closure(spark: S, d: str) -> D:
    """Suppliers export themselves; nations re-export their suppliers, regions their nations."""
    sup, nat = table(spark, d, "supplier"), table(spark, d, "nation")
    decls = sup.select(tagged("s", "s_suppkey").alias("path"), F.col("s_name").alias("name"), tagged("s", "s_suppkey").alias("id"), F.lit("public").alias("visibility"), F.lit(1).alias("line"))
    none = F.lit(None).cast("array<struct<local:string,imported:string>>")
    stars = sup.select(tagged("n", "s_nationkey").alias("path"), F.col("s_suppkey").alias("pos"), tagged("s", "s_suppkey").alias("file")).unionByName(nat.select(tagged("r", "n_regionkey").alias("path"), F.col("n_nationkey").cast("long").alias("pos"), tagged("n", "n_nationkey").alias("file")))
    return resolve.export_maps(decls, stars.select("path", "pos", "file", F.lit(True).alias("star"), F.lit(None).cast("string").alias("alias"), none.alias("names"))).select("path", "name", "id")


def display_names(spark: S, d: str) -> D:
    """Parts by name; brand, type and number as context, size as the signature."""
    p = table(spark, d, "part")
    ns = F.concat_ws(".", F.lit("catalog"), "p_type", "p_brand", F.concat(F.lit("k"), (F.col("p_partkey") % 40).cast("string")))
    decls = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), ns.alias("namespace"), F.lit("").alias("path"), F.concat(F.lit("part "), F.col("p_size").cast("string")).alias("signature"))
    found = labels.display_names(decls, overloads=False)
    return found.select(F.col("key").alias("p_partkey"), F.coalesce("display_name", "name").alias("label"))


def overload_labels(spark: S, d: str) -> D:
    """Overloads of a brand told apart by their signatures."""
    p = table(spark, d, "part")
    name = F.replace("p_brand", F.lit("#"), F.lit("_"))
    signature = F.concat(F.lit("fun "), name, F.lit("(size: Int = 1, key: K"), F.col("p_partkey").cast("string"), F.lit(") -> "), "p_type")
    decls = p.select(F.col("p_partkey").alias("key"), name.alias("name"), F.lit("catalog").alias("namespace"), F.lit("").alias("path"), signature.alias("signature"))
    return labels.display_names(decls).select(F.col("key").alias("p_partkey"), F.coalesce("display_name", "name").alias("label"))


def incremental_plan(spark: S, d: str) -> D:
    """Events as rebuilds with their circumstances."""
    e, k = table(spark, d, "events"), F.col("event_id")
    inputs = e.select(
        "event_id", (k % 11 != 0).alias("has_prior"), F.when(k % 5 != 0, 2).alias("extract_version"), F.when(k % 13 != 0, 2).otherwise(1).alias("prior_extract_version"), F.lit(1).alias("refine_version"),
        F.when(k % 17 != 0, 1).alias("prior_refine_version"), F.when(k % 19 == 0, "").otherwise("abc").alias("base_commit"), (k % 23 != 0).alias("has_architecture"), (k % 29 != 0).alias("is_repo"),
        F.when(k % 31 != 0, True).alias("is_toplevel"), (k % 37 != 0).alias("is_ancestor"), F.when(k % 41 != 0, F.col("user_id") % 60).alias("changed"), F.lit(100).alias("prior_files"),
    )
    return inputs.select("event_id", merge.plan_reason().alias("reason"))


def incremental_merge(spark: S, d: str) -> D:
    """Documents as classes; labelled ones as prior, those of a source with an odd number as changed."""
    docs, marks = table(spark, d, "documents"), table(spark, d, "labels")
    none = F.array().cast("array<string>")
    fresh = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("lang").alias("layer"), (F.col("doc_id") % 3 == 0).alias("core"), none.alias("tags"))
    prior = marks.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "gone").otherwise("fr").alias("layer"), (F.col("quality") == 1).alias("core"), F.array(F.lit("seen")).alias("tags"), F.when(F.col("toxic") == 0, "text").otherwise("").alias("description"))
    changed = docs.where(F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 2 == 1).select(F.col("source").alias("path")).distinct()
    names = docs.select(F.col("lang").alias("id")).distinct()
    found = merge.merge_classes(fresh, prior, changed, names)
    return found.select(F.col("id").alias("doc_id"), "layer", "core", F.size("tags").cast("long").alias("n_tags"), "description", "stale")


def flow_merge(spark: S, d: str) -> D:
    """Conversations with a system turn as previous flows, all as fresh ones; users with an error as changed."""
    c = table(spark, d, "conversations")
    nodes = c.select(F.col("conv_id").alias("flow"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 200).alias("node")).distinct()
    previous = c.where("role = 'system'").select(F.col("conv_id").alias("id")).distinct()
    changed = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("id")).distinct()
    found = merge.merge_flows(previous, c.select(F.col("conv_id").alias("id")).distinct(), nodes, changed)
    return found.select(F.col("id").alias("conv_id"), "origin", "needs_review")


def _entries(spark: S, d: str) -> D:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "layer-assignment").when(F.col("event_type") == "view", "describe").when(F.col("event_type") == "purchase", "flow").otherwise(F.col("event_type"))
    status = F.when(F.col("event_id") % 3 == 0, "inactive").when(F.col("event_id") % 3 == 1, "active")
    return e.select(F.col("event_id").alias("id"), kind.alias("type"), status.alias("status"), (F.col("user_id") * 40).alias("decl_id"), (F.col("event_id") % 30).alias("layer_id"), F.array(F.col("user_id"), F.col("user_id") * 30).alias("flow_nodes"))


def overlay_reconcile(spark: S, d: str) -> D:
    live = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    places = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return merge.reconcile(_entries(spark, d), live, places).select(F.col("id").alias("event_id"), "status", F.coalesce("change", F.lit("none")).alias("change"))


def overlay_layer_moves(spark: S, d: str) -> D:
    p = table(spark, d, "part")
    tags = F.when(F.col("p_size") % 10 == 0, F.array(F.lit("Test-only"))).otherwise(F.array().cast("array<string>"))
    classes = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("layer"), (F.col("p_size") > 40).alias("core"), tags.alias("tags"))
    moves = table(spark, d, "events").where("event_type in ('click', 'view')").select(F.col("event_id").alias("ord"), F.col("user_id").alias("decl_id"), F.col("event_type").alias("layer_id"), (F.col("value") > 20).alias("core"))
    return merge.apply_layer_moves(classes, moves).select(F.col("id").alias("p_partkey"), "layer", "core")


def overlay_descriptions(spark: S, d: str) -> D:
    classes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("description_zh"), F.lit(None).cast("string").alias("description_en"))
    edits = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("decl_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("description_zh"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("description_en"))
    return merge.apply_descriptions(classes, edits).select(F.col("id").alias("c_custkey"), "description_zh", "description_en")


def overlay_flows(spark: S, d: str) -> D:
    """Orders as flows over their parts; urgent ones come again as user flows of their customer, with a part less."""
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node")).distinct()
    sets = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    base = sets.select(F.col("l_orderkey").cast("string").alias("id"), F.lit("").alias("seed"), "nodes")
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(sets, F.col("o_orderkey") == F.col("l_orderkey"))
    user = urgent.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("id"), F.lit("").alias("seed"), F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(1))).alias("nodes"))
    return merge.apply_user_flows(base, user).select("id", "by_user", F.size("nodes").cast("long").alias("n_nodes"))


def jaccard_suppress(spark: S, d: str) -> D:
    """Pairs of orders whose parts are alike."""
    sets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("token")).distinct()
    found = merge.similar_pairs(sets, DEFAULT.min_jaccard)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


def inv1_duplicates(spark: S, d: str) -> D:
    p = table(spark, d, "part")
    found = quality.duplicate_labels(p.select(F.col("p_type").alias("layer"), F.lit(None).cast("string").alias("display_name"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), (F.col("p_size") > 10).alias("core")))
    return found.select("layer", "label", "n", F.get("ids", F.lit(0)).alias("first_id"))


def inv_label_width(spark: S, d: str) -> D:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 9 == 0, "漢字").otherwise("")).alias("label"), F.lit(1500.0).alias("width"))
    return quality.narrow_boxes(docs, 7.0, 8.0).select(F.col("id").alias("doc_id"), display_units(F.col("label")).cast("long").alias("units"), "needed")


def inv_bilingual(spark: S, d: str) -> D:
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("subject"), F.lit("description").alias("field"), F.when(F.col("quality") == 1, "x").otherwise(" ").alias("zh"), F.when(F.col("toxic") == 0, "y").alias("en"), (F.col("doc_id") % 2 == 0).alias("required"))
    return quality.incomplete_pairs(rows).select(F.col("subject").alias("doc_id"), "state")


def sequence_validate(spark: S, d: str) -> D:
    """Conversations as sequence diagrams: roles as participants, turns as steps to the next role."""
    c = table(spark, d, "conversations")
    roles = c.groupBy("conv_id", "role").agg(F.min("turn").alias("pos"))
    parts = roles.select(F.col("conv_id").alias("diagram"), "pos", F.concat(F.when(F.col("conv_id") % 10 == 0, "q:").otherwise("p:"), "role").alias("id"), F.when(F.col("role") == "system", "robot").otherwise("actor").alias("kind"), F.col("role").alias("name_zh"), F.when(F.col("conv_id") % 7 == 0, "").otherwise(F.col("role")).alias("name_en"), F.array().cast("array<string>").alias("nodes"))
    by = W.partitionBy("conv_id").orderBy("turn")
    prefix = F.when(F.col("conv_id") % 10 == 0, "q:").otherwise("p:")
    steps = c.select("conv_id", "turn", F.concat(prefix, "role").alias("src"), F.concat(prefix, F.coalesce(F.lead("role").over(by), F.lit("nobody"))).alias("dst"), "text")
    steps = steps.select(F.col("conv_id").alias("diagram"), F.col("turn").alias("pos"), "src", "dst", F.when(F.col("turn") % 5 == 4, "self").otherwise("call").alias("kind"), F.col("text").alias("label_zh"), F.lit("said").alias("label_en"))
    found = quality.validate_sequences(c.select(F.col("conv_id").alias("diagram")).distinct(), parts, steps, spark.createDataFrame([], "id string"))
    return found.groupBy("diagram", "rule").agg(F.count("*").alias("n")).withColumnRenamed("diagram", "conv_id")


def pipeline_validate(spark: S, d: str) -> D:
    """Orders as pipeline diagrams: line numbers as stages, parts as nodes."""
    li = table(spark, d, "lineitem")
    stages = li.groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list(tagged("p", "l_partkey"))).alias("nodes"))
    stages = stages.select(F.col("l_orderkey").alias("diagram"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("st"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("n").alias("name_zh"), F.when(F.col("l_linenumber") == 3, "").otherwise("n").alias("name_en"), "nodes")
    flow = li.where("l_quantity > 5").select(F.col("l_orderkey").alias("diagram"), tagged("p", "l_partkey").alias("node"))
    links = li.select(F.col("l_orderkey").alias("diagram"), F.concat(F.lit("st"), F.col("l_linenumber").cast("string")).alias("src"), F.concat(F.lit("st"), (F.col("l_linenumber") + 1).cast("string")).alias("dst"), F.when(F.col("l_returnflag") == "R", "odd").alias("kind"), F.lit("l").alias("label_zh"), F.lit("l").alias("label_en"))
    extras = spark.createDataFrame([], "diagram long, pos int, id string, kind string, name string, stage string")
    decls = table(spark, d, "part").where("p_size > 3").select(tagged("p", "p_partkey").alias("id"))
    found = quality.validate_pipelines(table(spark, d, "orders").select(F.col("o_orderkey").alias("diagram")), stages, extras, links, flow, decls)
    return found.groupBy("diagram", "rule").agg(F.count("*").alias("n")).withColumnRenamed("diagram", "o_orderkey")


def neighbors(spark: S, d: str) -> D:
    return graph.neighbors(adapter.graph_edges(spark, d), "p:1")


def file_walk_dedup(spark: S, d: str) -> D:
    """First page of each path without a pruned folder above it; pages with even ids have a manifest beside them."""
    from archloom.sources.files import pruned

    paths = adapter.page_paths(spark, d).select("page_id", F.concat(F.when(F.col("page_id") % 5 == 0, "build/").otherwise(""), "path").alias("path"), F.col("path").alias("realpath"))
    kept = pruned(paths, spark.createDataFrame([("de",), ("build",)], "name string"), spark.createDataFrame([("",)], "dir string"))
    return layers.latest_per(kept, ["realpath"], ["page_id"]).select("page_id", "path")


def changed_files(spark: S, d: str) -> D:
    """Files of clicks and, as status lines, of errors."""
    e = table(spark, d, "events")
    committed = e.where("event_type = 'click'").select(F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"))
    lines = e.where("event_type = 'error'").select(F.concat(F.lit("R  src/x.py -> src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("line"))
    return committed.union(lines.select(porcelain_path(F.col("line")))).distinct()


def golden_diff(spark: S, d: str) -> D:
    a = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"))
    b = a.where("p_partkey % 97 <> 0").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 89 == 0, F.col("price") + 1).otherwise(F.col("price") + 0.0000001).alias("price"))
    return quality.changes(a, b)


def type_function_counts(spark: S, d: str) -> D:
    return advisories.kind_counts(adapter.graph_nodes(spark, d))


def structure_json(spark: S, d: str) -> D:
    """K2: each layer's parts as one sorted JSON array, by its digest."""
    p = table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    return p.select(F.col("p_type").alias("layer"), F.sha2(F.to_json("ids"), 256).alias("digest"))


def kind_rollup(spark: S, d: str) -> D:
    """Extension: totals over layer and kind."""
    nodes = adapter.graph_nodes(spark, d).withColumn("language", F.substring("id", 1, 1))
    return layers.rollup(nodes)


def mermaid_text(spark: S, d: str) -> D:
    """Conversations as sequence diagrams, in text."""
    c = table(spark, d, "conversations")
    return mermaid.sequences(c.select(F.col("conv_id").alias("diagram"), F.col("turn").alias("pos"), F.col("role").alias("src"), F.col("text").alias("label"))).withColumnRenamed("diagram", "conv_id")


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, node_degrees, importance, hub_topk, core_per_layer, dispatch_index, flow_seeds, flow_reach, flow_trace, dispatch_flows, flow_subset_suppress, layer_assign, layer_fit,
        group_order, template_score, template_choice, language_histogram, namespace_histogram, vendored_dirs, dominant_unsupported, token_mentions, false_edge_guard, name_functions, import_edges,
        specifier_resolve, resolution_coverage, export_closure, display_names, overload_labels, incremental_plan, incremental_merge, flow_merge, overlay_reconcile, overlay_layer_moves,
        overlay_descriptions, overlay_flows, jaccard_suppress, inv1_duplicates, inv_label_width, inv_bilingual, sequence_validate, pipeline_validate, neighbors, file_walk_dedup, changed_files,
        golden_diff, type_function_counts, structure_json, kind_rollup, mermaid_text,
    )
}
