"""From a source tree to a layered declaration graph with flows: the operators in their order.

    python -m archloom.plans.analyze ROOT OUT [TEMPLATES]
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archloom.config import DEFAULT, DEFAULT_LAYERS, ROOT_MANIFESTS, STATE_DIR, EngineConfig
from archloom.functions.text import is_entry_point, package_root
from archloom.operators import advisories, flows, graph, labels, layers
from archloom.operators.layers import latest_per
from archloom.sources import configs, files
from archloom.sources.parse import declarations, low_confidence, parse_files, resolved_typescript, skipped
from archloom.tables import saved

def extract(contents: DataFrame, aliases: DataFrame | None = None, base_url: str | None = None) -> dict[str, DataFrame]:
    """Stages 2 to 8 over files (path, content, language): declarations with references, edges, degrees and labels."""
    parsed = saved(parse_files(contents))
    decls = declarations(parsed)
    refs, scripts = resolved_typescript(parsed, aliases, base_url)
    decls = decls.where(F.col("language") != "typescript").unionByName(scripts)
    decls = saved(decls.withColumn("key", F.xxhash64("path", "line", "kind", "id", "signature")).dropDuplicates(["key"]))
    nodes = latest_per(decls, ["id"], ["path", "line", "key"])
    edges = saved(graph.resolve_edges(decls, graph.mentions_of(contents)))
    scored = graph.importance(graph.degrees(nodes, edges).join(nodes.select("id", "visibility", "name"), "id")).select("id", "in_degree", "out_degree", "importance")
    named = labels.display_names(decls.select("key", "name", "namespace", "path", "signature")).select("key", "display_name")
    return {"declarations": saved(decls.join(scored, "id").join(named, "key")), "edges": edges, "resolution": refs, "skipped": skipped(parsed).unionByName(low_confidence(decls).select("path", "line", "reason"))}


def layered(model: dict[str, DataFrame], config_layers: list[dict], config: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """Stages 10 to 13 over an extract: layers, core, hubs, dispatch and flows."""
    decls, edges = model["declarations"], model["edges"]
    spark = decls.sparkSession
    segments, suffixes = configs.layer_rules(configs.with_rest(config_layers))
    placed = layers.assign_layers(
        decls.select(F.col("key").alias("id"), "name", "path", "namespace"), spark.createDataFrame(segments, "layer string, layer_pos int, segment string"), spark.createDataFrame(suffixes, "layer string, layer_pos int, suffix string")
    ).select(F.col("id").alias("key"), "layer")
    full = decls.join(placed, "key")
    nodes = saved(latest_per(full, ["id"], ["path", "line", "key"]))
    hub = saved(graph.hubs(nodes, config.hub_percentile).select("id"))
    marked = saved(graph.core(nodes, config).join(hub.withColumn("hub", F.lit(True)), "id", "left").withColumn("hub", F.coalesce("hub", F.lit(False))))
    index = saved(graph.dispatch_index(marked))
    seeds = saved(flows.select_seeds(marked, config))
    traced = saved(flows.trace_flows(seeds, marked, edges, hub, index, marked.select("id", "refs"), config))
    order = seeds.select(F.concat(F.lit("flow:"), "id").alias("flow"), F.concat("seed_kind", "id").alias("ord"))
    kept = flows.suppress_contained(traced.where("pos is not null").join(order, "flow").select("flow", "ord", "node"))
    flags = full.join(marked.select("id", "core", "hub"), "id")
    stayed, dispatched = saved(traced.join(kept, "flow", "left_semi")), saved(flows.dispatch_flows(marked, index, edges, hub, config))
    return {
        "classes": flags, "flows": stayed, "seeds": seeds, "dispatch": graph.capped(index, config.max_fanout),
        "dispatch_flows": dispatched, "flow_list": flows.flow_list(dispatched, stayed, seeds), "fit": layers.template_fit(marked, spark.createDataFrame([(x["id"],) for x in configs.with_rest(config_layers)], "id string")),
        "languages": advisories.language_counts(flags), "namespaces": advisories.namespace_histogram(flags),
    }


def detect_template(spark: SparkSession, root: str, files_: DataFrame, folder: str | None) -> tuple[list[dict], DataFrame | None, str | None]:
    """(templates, their scores on a pruned listing (path), the reason why there are none)."""
    if folder is None:
        return [], None, "no-plugin-root"
    if not os.path.isdir(folder):
        return [], None, "no-templates-dir"
    templates = configs.load_templates(folder)
    if not templates:
        return [], None, "no-valid-templates"
    signals = spark.createDataFrame(configs.signal_rows(templates), "template string, kind string, match string, weight int")
    listed = spark.createDataFrame([(x["id"],) for x in templates], "template string")
    texts = spark.createDataFrame([(configs.manifest_text(root),)], "text string")
    near = files_.where(F.size(F.split("path", "/")) <= 2)  # files count in the root and the folders below
    scores = layers.template_scores(near, texts, layers.directory_closure(files_), signals)
    return templates, saved(listed.join(scores, "template", "left").select("template", F.coalesce("score", F.lit(0)).alias("score"))), None


def found_advisories(spark: SparkSession, everything: DataFrame, contents: DataFrame, decls: DataFrame, n_files: int) -> DataFrame:
    """S2, S12, A6, A7, A11, T7 over a pruned listing of all files (path), contents and declarations."""
    entries = decls.where(is_entry_point(F.col("name"))).select("namespace")
    roots = advisories.own_roots(files.manifest_rows(everything, contents, ROOT_MANIFESTS).select("text"), entries)
    packages = decls.select(F.element_at(F.split("path", "/"), 1).alias("dir"), package_root(F.col("namespace")).alias("root"), F.struct("path", "line", "key").alias("at"))
    placed = packages.groupBy("dir", "root").agg(F.min("at").alias("at"), F.count("*").alias("m"))
    order = placed.select("dir", "root", F.row_number().over(W.partitionBy("dir").orderBy("at")).cast("long").alias("ord"))
    flooded = advisories.vendored(packages.join(order, ["dir", "root"]).select("dir", "root", "ord"), roots)
    supported = spark.createDataFrame([(n_files,)], "n long")
    return advisories.advisories(flooded, advisories.dominant_unsupported(files.census(everything), files.unread_languages(spark), supported))


def analyze(spark: SparkSession, root: str, config: EngineConfig = DEFAULT, templates: str | None = None) -> dict[str, DataFrame]:
    """All tables of a local source tree. templates: a folder of layer templates, which are scored on the tree.

    Layers come from architecture.yml or .json in the project's state folder, else from the best template, else they are the
    default ones; `detection` tells which and why.
    """
    state = os.path.join(root, STATE_DIR)
    skip = saved(files.skip_names(spark, files.skip_lines(root)))
    listing = files.listing(spark, root)
    everything = saved(files.pruned(listing, skip, files.manifest_dirs(listing)))
    listed = files.scan(listing, skip)
    texts = files.read_contents(spark, root).select("path", "content")
    contents = saved(listed.select("path", "language").join(texts, "path"))
    tsconfig = configs.load_tsconfig(root)
    rows = configs.alias_rows(tsconfig)
    aliases = spark.createDataFrame(rows, "pattern string, target string, pattern_pos int, target_pos int") if rows else None
    model = extract(contents, aliases, tsconfig["base_url"])
    known, scores, reason = detect_template(spark, root, everything, templates)
    best = layers.choose_template(scores).first().template if known else "clean-architecture"
    chosen, origin = configs.resolve_layers(state, next((x["layers"] for x in known if x["id"] == best), None), DEFAULT_LAYERS)
    why = "ai-phase0" if origin.startswith("architecture") else reason
    model["detection"] = spark.createDataFrame([("custom" if origin.startswith("architecture") and not known else best, origin, why)], "chosen string, origin string, reason string")
    model["template_scores"] = scores if known else spark.createDataFrame([], files.MODEL["template_scores"])
    model["advisories"] = found_advisories(spark, everything.select("path"), texts, model["declarations"], contents.count())
    return model | layered(model, chosen, config)


def main(root: str, out: str, templates: str | None = None) -> None:
    from archloom.sinks.documents import write_tables

    spark = SparkSession.builder.appName("analyze").getOrCreate()
    write_tables(out, **analyze(spark, root, templates=templates))


if __name__ == "__main__":
    main(*sys.argv[1:4])
