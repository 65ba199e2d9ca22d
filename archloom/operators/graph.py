"""The declaration graph: references to edges, degrees, importance, hubs, core rows, dispatch keys.

Declarations have id, name, namespace, path, kind, visibility, supertypes, refs; edges have src, dst, kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archloom.config import DEFAULT, EngineConfig
from archloom.functions.text import identifiers, is_entry_point, module_token, short_name
from archloom.tables import FEW, saved


def joinable(df: DataFrame) -> tuple[DataFrame, bool]:
    """df for a join: broadcast where it has few rows, and whether it has."""
    few = df.count() <= FEW
    return (F.broadcast(df) if few else df.hint("merge")), few


def resolve_edges(decls: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """J1-J3. Edges (src, dst, kind) from refs (uses) and supertypes (extends).

    A symbol that is some id means that declaration. Otherwise its short name counts: a declaration of the same file
    goes first, then one of the same namespace, then a lone one; several of equal standing give no edge. With
    `mentions` (path, token), a uses edge to another file by short name alone needs the target's module token there.
    """
    named = decls.where("id is not null")
    # Rows of one id and path speak together, for all their namespaces: those with several are looked up, so that the
    # references of all others aren't shuffled for them.
    several = named.groupBy(F.col("id").alias("i"), F.col("path").alias("p")).agg(F.array_sort(F.collect_set(F.struct("namespace"))).alias("spaces"))
    several, few = joinable(saved(several.where(F.size("spaces") > 1)))
    owners = named.join(several, (F.col("id") == F.col("i")) & F.col("path").eqNullSafe(F.col("p")), "left")
    owners = owners.select(F.col("id").alias("src"), F.col("path").alias("src_path"), F.coalesce("spaces", F.array(F.struct("namespace"))).alias("spaces"), "refs", "supertypes")
    owners = owners if few else saved(owners)
    said = lambda c, kind: owners.select("src", "src_path", "spaces", F.explode(c).alias("raw"), F.lit(kind).alias("kind"))
    symbols = said("refs", "uses").unionByName(said("supertypes", "extends"))
    # What a symbol means depends on where it is said alone: each (file, namespaces, symbol) is resolved once, and a name's declarations
    # are reduced to their least and greatest id before they meet it, so that common names aren't paired with all that bear them.
    place = ["src_path", "spaces", "raw"]
    places = saved(symbols.select(*place).where("raw is not null").distinct())
    exact = named.select(F.col("id").alias("raw")).join(joinable(places.select("raw").distinct())[0], "raw", "left_semi").distinct().withColumn("dst", F.col("raw"))
    known = saved(places.join(exact.hint("merge"), "raw", "left"))
    rest = known.where("dst is null").select(*place, short_name(F.col("raw")).alias("short")).where("short is not null")
    asked = saved(rest.select("src_path", "spaces", "short").distinct())
    targets = named.select(F.col("name").alias("short"), "path", "namespace", F.struct(F.col("id").alias("dst"), F.col("path").alias("dst_path"), F.col("namespace").alias("dst_ns")).alias("least"), F.col("id").alias("most"))
    ends = F.min("least").alias("least"), F.max("most").alias("most")
    near = saved(targets.join(joinable(asked.select("short").distinct())[0], "short", "left_semi").groupBy("short", "path", "namespace").agg(*ends))
    best = None
    for level, by, own in ((0, "path", F.array(F.struct(F.col("src_path").alias("x")))), (1, "namespace", F.transform("spaces", lambda x: F.struct(x["namespace"].alias("x")))), (2, None, None)):
        if by is None:
            met = asked.join(near.groupBy("short").agg(*ends).hint("merge"), "short")
        else:
            group = near.where(F.col("path").isNotNull()) if level == 0 else near
            group = group.groupBy(F.col("short").alias("name"), by).agg(*ends)
            from_ = asked.withColumn("at", F.explode(own))
            met = from_.join(group.hint("merge"), (F.col("short") == F.col("name")) & F.col("at.x").eqNullSafe(F.col(by)))
        met = met.select("short", "src_path", "spaces", F.lit(level).alias("level"), "least", "most")
        best = met if best is None else best.unionByName(met)
    best = best.groupBy("short", "src_path", "spaces", "level").agg(*ends).groupBy("short", "src_path", "spaces").agg(F.min(F.struct("level", "least", "most")).alias("b"))
    best = best.where(F.col("b.least.dst") == F.col("b.most")).select("short", F.col("src_path").alias("p"), F.col("spaces").alias("q"), "b.least.*")
    best = rest.withColumnRenamed("short", "s").join(best.hint("merge"), (F.col("s") == F.col("short")) & F.col("src_path").eqNullSafe(F.col("p")) & (F.col("spaces") == F.col("q")))
    best = best.select(*place, "dst", "dst_path", "dst_ns")
    if mentions is None:
        best = best.select(*place, "dst", F.lit(True).alias("open"))
    else:
        best = saved(best.withColumn("token", F.when(F.col("src_path") != F.col("dst_path"), module_token(F.col("dst_ns"), F.col("dst_path")))))
        heard = mentions.join(best.select("token").distinct(), "token", "left_semi").select(F.col("path").alias("src_path"), "token", F.lit(True).alias("heard")).distinct()
        best = best.join(heard, ["src_path", "token"], "left").select(*place, "dst", F.coalesce(F.col("src_path") == F.col("dst_path"), F.lit(False)).alias("near"), F.coalesce("heard", F.lit(False)).alias("heard"))
        best = best.select(*place, "dst", (F.col("near") | F.col("heard")).alias("open"))
    means = saved(known.where("dst is not null").select(*place, "dst", F.lit(True).alias("open")).unionByName(best).select(F.col("src_path").alias("p"), F.col("spaces").alias("q"), F.col("raw").alias("r"), "dst", "open"))
    edges = symbols.join(joinable(means)[0], F.col("src_path").eqNullSafe(F.col("p")) & (F.col("spaces") == F.col("q")) & (F.col("raw") == F.col("r")))
    return edges.where((F.col("src") != F.col("dst")) & (F.col("open") | (F.col("kind") == "extends"))).select("src", "dst", "kind").distinct()


def mentions_of(files: DataFrame) -> DataFrame:
    """P5: (path, token) of files (path, content)."""
    return files.select("path", F.explode(identifiers(F.col("content"))).alias("token"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1: (id, in_degree, out_degree) for every node; one pass over the edges."""
    end = lambda id_, o, i: F.struct(id_.alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(False).alias("known"))
    ends = edges.select(F.explode(F.array(end(F.col("src"), 1, 0), end(F.col("dst"), 0, 1))).alias("e")).select("e.*")
    zero = nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(True).alias("known"))
    counted = ends.unionByName(zero).groupBy("id").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"), F.max("known").alias("known"))
    return counted.where(F.col("known") & F.col("id").isNotNull()).drop("known")


def importance(degreed: DataFrame, config: EngineConfig = DEFAULT, digits: int | None = 3) -> DataFrame:
    """A2: weighted share of the largest degrees, 0.5 in a graph without edges, less for private rows. Adds importance.

    The maxima are one row, joined by broadcast. visibility and name are used where they exist.
    """
    top = degreed.agg(F.max("in_degree").alias("mi"), F.max("out_degree").alias("mo"))
    out = degreed.crossJoin(F.broadcast(top))
    score = F.lit(config.in_weight) * F.col("in_degree") / F.greatest("mi", F.lit(1)) + F.lit(config.out_weight) * F.col("out_degree") / F.greatest("mo", F.lit(1))
    if "name" in degreed.columns and config.entry_weight:
        score = score + F.when(is_entry_point(F.col("name")), config.entry_weight).otherwise(0.0)
    score = F.when((F.col("mi") == 0) & (F.col("mo") == 0), F.lit(0.5)).otherwise(score)
    if "visibility" in degreed.columns:
        score = F.when(F.col("visibility") == "private", score * config.private_factor).otherwise(score)
    return out.withColumn("importance", F.bround(score, digits) if digits is not None else score).drop("mi", "mo")


def hubs(degreed: DataFrame, percentile: float = DEFAULT.hub_percentile) -> DataFrame:
    """The floor(n * percentile) rows of largest in_degree, ids ascending, among those above 0.

    The cut is found on the histogram of degrees; only rows at the cut itself are ordered.
    """
    some = degreed.where(F.col("in_degree") > 0)
    histogram = some.groupBy("in_degree").agg(F.count("*").alias("n"))
    down = W.orderBy(F.desc("in_degree"))
    cut = histogram.select("in_degree", (F.sum("n").over(down) - F.col("n")).alias("before"), F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    cut = cut.withColumn("k", F.floor(F.col("total") * F.lit(percentile)))
    at = cut.where((F.col("before") < F.col("k"))).agg(F.min("in_degree").alias("d"), F.max_by(F.col("k") - F.col("before"), "before").alias("left")).first()
    if at is None or at.d is None:
        return some.limit(0)
    return some.where(F.col("in_degree") > at.d).unionByName(some.where(F.col("in_degree") == at.d).orderBy("id").limit(int(at.left)))


def core(scored: DataFrame, config: EngineConfig = DEFAULT, layer: str = "layer") -> DataFrame:
    """Adds core: the first k of each layer by importance, above 0, and entry points (where name exists).

    k is core_max at most, so each task first keeps that many rows of a layer; only those are ranked, and the chosen ones
    are joined back. Layers are counted apart. Rows of one id and layer are marked alike.
    """
    n = scored.groupBy(layer).agg(F.count("*").alias("_n"))
    k = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(config.core_percentile))), F.lit(config.core_max))
    k = F.greatest(k, F.least(F.lit(config.core_min), F.col("_n")))
    rank = F.row_number().over(W.partitionBy(layer).orderBy(F.desc("importance"), "id"))
    most = max(config.core_max, config.core_min)
    top = scored.select(layer, "id", "importance").withColumn("_r", rank).where(F.col("_r") <= most)
    best = top.join(n, top[layer].eqNullSafe(n[layer])).where((F.col("_r") <= k) & (F.col("importance") > 0)).select(top[layer].alias("_layer"), F.col("id").alias("_id")).distinct()
    marked = scored.join(best, scored[layer].eqNullSafe(F.col("_layer")) & (F.col("id") == F.col("_id")), "left")
    chosen = F.col("_id").isNotNull()
    chosen = chosen | is_entry_point(F.col("name")) if "name" in scored.columns else chosen
    return marked.withColumn("core", chosen).drop("_layer", "_id")


def dispatch_index(decls: DataFrame, least: int = 2) -> DataFrame:
    """A5: (key, impl, impls, rank): implementors of each short supertype name with at least two, best first.

    decls: id, supertypes, importance. A declaration counts once for a key. Keys are counted apart from the ranking, so
    that a bound on the rank is pushed below the shuffle.
    """
    named = decls.select("id", "importance", F.explode("supertypes").alias("s")).select(short_name(F.col("s")).alias("key"), F.col("id").alias("impl"), "importance").where(F.col("key").isNotNull())
    once = named.groupBy("key", "impl").agg(F.max("importance").alias("importance"))
    sizes = once.groupBy("key").agg(F.count("*").alias("impls")).where(F.col("impls") >= least)
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("importance"), "impl")))
    return ranked.join(sizes, "key").select("key", "impl", "impls", "rank")


def capped(index: DataFrame, fanout: int = DEFAULT.max_fanout) -> DataFrame:
    """The first `fanout` implementors, and how many more there are."""
    return index.where(F.col("rank") <= fanout).withColumn("omitted", F.greatest(F.col("impls") - fanout, F.lit(0)))


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    """(id, direction, kind) of the nodes next to one."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), F.lit("out").alias("direction"), "kind")
    return out.unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("id"), F.lit("in").alias("direction"), "kind")).distinct()
