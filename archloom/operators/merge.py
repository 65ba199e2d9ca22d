"""Incremental rebuilds and persisted user edits as joins on the new model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archloom.config import DEFAULT, EngineConfig
from archloom.functions.text import filled, has_excluded_tag, jaccard
from archloom.operators.layers import latest_per


def plan_reason(config: EngineConfig = DEFAULT) -> Column:
    """M1: why a rebuild is full, or incremental. Over columns has_prior, extract_version, prior_extract_version,
    refine_version, prior_refine_version, base_commit, has_architecture, is_repo, is_toplevel, is_ancestor, changed
    (null: the diff failed), prior_files. A null current version skips its test."""
    return (
        F.when(~F.col("has_prior"), "no-prior-build")
        .when(F.col("extract_version").isNotNull() & ~F.col("extract_version").eqNullSafe(F.col("prior_extract_version")), "extract-version-changed")
        .when(F.col("refine_version").isNotNull() & ~F.col("refine_version").eqNullSafe(F.col("prior_refine_version")), "refine-version-changed")
        .when(filled(F.col("base_commit")).isNull(), "no-anchor-commit")
        .when(~F.col("has_architecture"), "no-architecture-yml")
        .when(~F.col("is_repo"), "not-a-git-repo")
        .when(~F.coalesce("is_toplevel", F.lit(False)), "root-not-repo-toplevel")
        .when(~F.coalesce("is_ancestor", F.lit(False)), "base-unreachable")
        .when(F.col("changed").isNull(), "git-diff-failed")
        .when((F.col("prior_files") > 0) & (F.col("changed") > F.col("prior_files") * config.max_change_ratio), "too-many-changes")
        .otherwise("incremental")
    )


def merge_classes(fresh: DataFrame, prior: DataFrame, changed: DataFrame, layers: DataFrame) -> DataFrame:
    """Fresh rows with what unchanged prior ones bring: descriptions, tags, core, layer where it still exists.

    fresh: id, path, layer, core, tags; prior: id, layer, core, tags, description; changed: path; layers: id.
    A core row without description is stale.
    """
    old = prior.select("id", F.col("layer").alias("p_layer"), F.col("core").alias("p_core"), F.col("tags").alias("p_tags"), F.col("description").alias("p_description"), F.lit(True).alias("p"))
    live = layers.select(F.col("id").alias("p_layer"), F.lit(True).alias("p_live"))
    joined = fresh.join(changed.select("path", F.lit(True).alias("dirty")).distinct(), "path", "left").join(old, "id", "left").join(F.broadcast(live), "p_layer", "left")
    reuse = F.col("p").isNotNull() & F.col("dirty").isNull()
    description = F.when(reuse, filled(F.col("p_description")))
    is_core = F.coalesce("core", F.lit(False)) | (reuse & F.coalesce("p_core", F.lit(False)))
    return joined.select(
        "id", "path", F.when(reuse & F.col("p_live"), F.col("p_layer")).otherwise(F.col("layer")).alias("layer"), is_core.alias("core"),
        F.when(reuse & (F.size("p_tags") > 0), F.col("p_tags")).otherwise(F.col("tags")).alias("tags"), description.alias("description"), (is_core & description.isNull()).alias("stale"),
        (F.col("dirty").isNotNull()).alias("changed"),
    )


def merge_flows(previous: DataFrame, fresh: DataFrame, flow_nodes: DataFrame, changed_ids: DataFrame) -> DataFrame:
    """M3, T4: (id, origin, needs_review): all previous flows, flagged where a node changed, and new ones, flagged."""
    hit = flow_nodes.join(changed_ids.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("flow").alias("id"), F.lit(True).alias("hit")).distinct()
    old = previous.join(hit, "id", "left").select("id", F.lit("previous").alias("origin"), F.coalesce("hit", F.lit(False)).alias("needs_review"))
    new = fresh.join(previous.select("id"), "id", "left_anti").select("id", F.lit("fresh").alias("origin"), F.lit(True).alias("needs_review"))
    return old.unionByName(new)


def all_alive(refs: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """(key, alive): whether every ref of a key is live. A key whose ref is null alone has nothing to miss."""
    known = live.select(F.col("id").alias("ref"), F.lit(1).alias("live")).distinct()
    return refs.join(known, "ref", "left").groupBy(key).agg((F.count_if(F.col("ref").isNotNull() & F.col("live").isNull()) == 0).alias("alive"))


def reconcile(entries: DataFrame, live_ids: DataFrame, live_layers: DataFrame) -> DataFrame:
    """Entries with their new status and the change (suspended, reactivated or null).

    entries: id, type, status, decl_id, layer_id, flow_nodes. An entry of unknown type counts as dead.
    """
    ids, layers = live_ids.select(F.col("id").alias("decl_id"), F.lit(True).alias("_d")).distinct(), live_layers.select(F.col("id").alias("layer_id"), F.lit(True).alias("_l")).distinct()
    nodes = all_alive(entries.where(F.col("type") == "flow").select("id", F.explode_outer("flow_nodes").alias("ref")), live_ids, "id").withColumnRenamed("alive", "_f")
    joined = entries.join(ids, "decl_id", "left").join(F.broadcast(layers), "layer_id", "left").join(nodes, "id", "left")
    has_decl, has_layer = F.col("_d").isNotNull(), F.col("_l").isNotNull()
    alive = F.when(F.col("type") == "layer-assignment", has_decl & has_layer).when(F.col("type") == "describe", has_decl).when(F.col("type") == "flow", F.coalesce("_f", F.lit(True))).otherwise(F.lit(False))
    status = F.coalesce("status", F.lit("active"))
    change = F.when(alive & (status == "inactive"), "reactivated").when(~alive & (status == "active"), "suspended")
    new = F.when(change == "reactivated", "active").when(change == "suspended", "inactive").otherwise(status)
    return joined.select(*entries.drop("status").columns, new.alias("status"), change.alias("change"))


def apply_layer_moves(classes: DataFrame, moves: DataFrame) -> DataFrame:
    """M6: classes with the layer and core of their last active move. moves: ord, decl_id, layer_id, core.

    Rows with an excluded tag stay; core is only ever set.
    """
    final = moves.groupBy("decl_id").agg(F.max_by("layer_id", "ord").alias("_layer"), F.bool_or(F.coalesce("core", F.lit(False))).alias("_core")).withColumnRenamed("decl_id", "id")
    joined = classes.join(final, "id", "left")
    moved = F.col("_layer").isNotNull() & ~has_excluded_tag(F.col("tags"))
    return joined.withColumn("layer", F.when(moved, F.col("_layer")).otherwise(F.col("layer"))).withColumn("core", F.col("core") | (moved & F.col("_core"))).drop("_layer", "_core")


def apply_descriptions(classes: DataFrame, edits: DataFrame) -> DataFrame:
    """M8: of each half the last edit that isn't empty. edits: ord, decl_id, description_zh, description_en."""
    own = [F.max_by(F.col(c), F.when(filled(F.col(c)).isNotNull(), F.col("ord"))).alias(f"_{c}") for c in ("description_zh", "description_en")]
    joined = classes.join(edits.groupBy("decl_id").agg(*own).withColumnRenamed("decl_id", "id"), "id", "left")
    for c in ("description_zh", "description_en"):
        joined = joined.withColumn(c, F.coalesce(filled(F.col(f"_{c}")), F.col(c))).drop(f"_{c}")
    return joined


def alike_flows(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a_key, b_key) of flows (key, id, seed, nodes) with the same id, the same filled seed, or Jaccard of `least` > 0.

    The first two are equi-joins. The third meets on prefixes alone: with nodes in order of rarity over both sides, two sets
    this similar share one of their first size - ceil(least * size) + 1 nodes, so popular nodes are hardly ever paired.
    """
    x = a.select(F.col("key").alias("a_key"), "id", filled(F.col("seed")).alias("seed"), F.array_distinct("nodes").alias("nx"))
    y = b.select(F.col("key").alias("b_key"), "id", filled(F.col("seed")).alias("seed"), F.array_distinct("nodes").alias("ny"))
    named = x.join(y.select("b_key", "id"), "id").select("a_key", "b_key").unionByName(x.join(y.select("b_key", "seed"), "seed").select("a_key", "b_key"))
    left, right = x.select("a_key", F.explode("nx").alias("token")), y.select("b_key", F.explode("ny").alias("token"))
    spread = left.select("token").unionByName(right.select("token")).groupBy("token").agg(F.count("*").alias("held"))
    heads = _heads(left, "a_key", spread, least).join(_heads(right, "b_key", spread, least).withColumnRenamed("n", "m"), "token")
    fits = F.least("m", "n") >= F.greatest("m", "n") * F.lit(least) - F.lit(1e-9)
    pairs = heads.where(fits).select("a_key", "b_key").distinct()
    both = pairs.join(x.select("a_key", "nx"), "a_key").join(y.select("b_key", "ny"), "b_key")
    return named.unionByName(both.where(jaccard(F.col("nx"), F.col("ny")) >= least).select("a_key", "b_key")).distinct()


def _heads(sets: DataFrame, key: str, spread: DataFrame, least: float) -> DataFrame:
    """(key, token, n): the rarest tokens of each set (key, token) that a set of Jaccard `least` must share one of."""
    at = F.row_number().over(W.partitionBy(key).orderBy("held", "token"))
    placed = sets.join(spread, "token").select(key, "token", at.alias("at"), F.count("*").over(W.partitionBy(key)).alias("n"))
    return placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1).select(key, "token", "n")


def apply_user_flows(flows: DataFrame, user: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """M7: flows after the user's flows came in their order: each drops those of its id or seed, or alike by Jaccard.

    flows: id (unique), seed, nodes (distinct); user: ord (unique), id, seed, nodes. A user flow drops others
    whether or not it stays itself, so the order matters among user flows alone: a later one drops an earlier one.
    """
    u = user.select(F.col("ord").alias("key"), "id", "seed", "nodes")
    gone = alike_flows(flows.select(F.col("id").alias("key"), "id", "seed", "nodes"), u, config.min_jaccard).select(F.col("a_key").alias("id")).distinct()
    evicted = alike_flows(u, u, config.min_jaccard).where(F.col("b_key") > F.col("a_key")).select(F.col("a_key").alias("ord")).distinct()
    left = flows.join(gone, "id", "left_anti").select("id", "seed", "nodes", F.lit(False).alias("by_user"))
    return left.unionByName(user.join(evicted, "ord", "left_anti").select("id", "seed", "nodes", F.lit(True).alias("by_user")))


def similar_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of ids a < b with Jaccard of at least `least` > 0. sets: id, token (distinct).

    Pairs meet on tokens of their prefixes alone: with tokens in order of rarity, two sets this similar share one of
    their first size - ceil(least * size) + 1 tokens. Frequent tokens are thus never paired.
    """
    spread = sets.groupBy("token").agg(F.count("*").alias("held"))
    head = _heads(sets, "id", spread, least)
    a, b = head.select(F.col("id").alias("a"), "token", F.col("n").alias("na")), head.select(F.col("id").alias("b"), "token", F.col("n").alias("nb"))
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least) - F.lit(1e-9))
    pairs = a.join(b, "token").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    whole = sets.groupBy("id").agg(F.collect_set("token").alias("t"))
    both = pairs.join(whole.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(whole.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= least)


def once_per_id(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """T5: the first row of each id within keys; rows without id all stay."""
    named = latest_per(rows.where(F.col("id").isNotNull()), [*keys, "id"], order)
    return named.unionByName(rows.where(F.col("id").isNull()))


def last_wins(lines: DataFrame, defaults: list[str]) -> DataFrame:
    """Names to skip: defaults and lines (ord, line) in order; # starts a comment, -name removes."""
    body = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    asked = lines.select("ord", body.alias("b")).where(F.col("b") != "").select("ord", F.regexp_replace("b", "^-", "").alias("name"), (~F.startswith("b", F.lit("-"))).alias("keep"))
    given = lines.sparkSession.createDataFrame([(-1, d, True) for d in defaults], "ord int, name string, keep boolean")
    return given.unionByName(asked).groupBy("name").agg(F.max_by("keep", "ord").alias("keep")).where("keep").select("name")


def without_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """M9: overlay entries less those of the given ids."""
    return entries.join(ids.select("id").distinct(), "id", "left_anti")


def work_counts(classes: DataFrame, flows: DataFrame) -> DataFrame:
    """One row of how many rows need a description and how many flows a review."""
    return classes.agg(F.count_if("stale").alias("stale")).crossJoin(flows.agg(F.count_if("needs_review").alias("needs_review")))


#: M4: what a merged model has; groups of layers aren't among it, they come from the layer configuration anew.
MERGED = ("project", "layers", "edges", "flows")


def merged_model(fresh: dict, **merged) -> dict:
    """M4: the parts of a merged model: of the fresh one what was not merged, without any part that MERGED doesn't name."""
    return {name: merged.get(name, fresh.get(name)) for name in MERGED if name in merged or name in fresh}
