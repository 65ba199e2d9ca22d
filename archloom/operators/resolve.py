"""Module resolution: import scopes, specifiers, export maps, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.operators.layers import latest_per
from archloom.tables import saved

#: The order in which endings are tried.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def normal_path(path: Column) -> Column:
    """A path without . and .. segments; .. beyond the root goes."""

    def step(done: Column, s: Column) -> Column:
        return F.when((s == "") | (s == "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_scopes(imports: DataFrame) -> DataFrame:
    """(path, local, source, imported), of each local name the first binding. imports: path, pos, raw, bindings."""
    each = imports.select("path", "pos", F.col("raw").alias("source"), F.posexplode("bindings").alias("at", "b")).select("path", "pos", "at", "source", F.col("b.local").alias("local"), F.col("b.imported").alias("imported"))
    return latest_per(each, ["path", "local"], ["pos", "at", "source"]).drop("pos", "at")


def candidates(base: Column) -> Column:
    """Files to try for a path, in order: endings, endings in place of a script ending, itself, its index."""
    stem = F.regexp_replace(base, r"\.(js|jsx|mjs|cjs)$", "")
    script = base.rlike(r"\.(js|jsx|mjs|cjs)$")
    swapped = [F.when(script, F.concat(stem, F.lit(e))) for e in ENDINGS]
    return F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS], *swapped, base, *[F.concat(base, F.lit(f"/index{e}")) for e in ENDINGS])


def resolve_specifiers(wanted: DataFrame, files: DataFrame, aliases: DataFrame | None = None, base_url: str | None = None) -> DataFrame:
    """Adds file and via (relative, alias, baseUrl, external, unresolved) to (path, source).

    aliases: pattern (with at most one *), target, pattern_pos, target_pos; the first pattern that fits is final, so a
    source that fits one but has no file is unresolved. All candidates are looked up by one equi-join on files (path).
    """
    pairs = wanted.select("path", "source").distinct()
    relative = F.startswith("source", F.lit("."))
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    tries = pairs.where(relative).select("path", "source", F.lit("relative").alias("via"), F.lit(0).alias("target_pos"), normal_path(F.concat(folder, F.lit("/"), F.col("source"))).alias("base"))
    fitted = None
    if aliases is not None:
        star = F.instr("pattern", "*")
        pre, post = F.expr("substring(pattern, 1, instr(pattern, '*') - 1)"), F.expr("substring(pattern, instr(pattern, '*') + 1)")
        fits = F.when(star > 0, F.startswith("source", pre) & F.endswith("source", post) & (F.length("source") >= F.length(pre) + F.length(post))).otherwise(F.col("source") == F.col("pattern"))
        rest = F.when(star > 0, F.expr("substring(source, instr(pattern, '*'), length(source) - length(pattern) + 1)")).otherwise(F.lit(""))
        met = pairs.where(~relative).join(F.broadcast(aliases), fits).withColumn("rest", rest)
        first = met.groupBy("path", "source").agg(F.min("pattern_pos").alias("pattern_pos"))
        met = met.join(first, ["path", "source", "pattern_pos"])
        fitted = first.select("path", "source")
        base = F.expr("CASE WHEN instr(target, '*') > 0 THEN concat(substring(target, 1, instr(target, '*') - 1), rest, substring(target, instr(target, '*') + 1)) ELSE target END")
        at = F.concat(F.lit((base_url or "") + "/"), base)
        tries = tries.unionByName(met.select("path", "source", F.lit("alias").alias("via"), "target_pos", normal_path(at).alias("base")))
    bare = pairs.where(~relative) if fitted is None else pairs.where(~relative).join(fitted, ["path", "source"], "left_anti")
    if base_url is not None:
        tries = tries.unionByName(bare.select("path", "source", F.lit("baseUrl").alias("via"), F.lit(0).alias("target_pos"), normal_path(F.concat(F.lit(base_url + "/"), F.col("source"))).alias("base")))
    probes = tries.select("path", "source", "via", "target_pos", F.posexplode(candidates(F.col("base"))).alias("prio", "file")).where(F.col("file").isNotNull())
    found = probes.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").groupBy("path", "source").agg(F.min_by(F.struct("file", "via"), F.struct("target_pos", "prio")).alias("f"))
    out = pairs.join(found, ["path", "source"], "left")
    if fitted is not None:
        out = out.join(fitted.withColumn("_fit", F.lit(True)), ["path", "source"], "left")
    missed = relative | (F.col("_fit") if fitted is not None else F.lit(False))
    via = F.coalesce(F.col("f.via"), F.when(F.coalesce(missed, F.lit(False)), F.lit("unresolved")).otherwise(F.lit("external")))
    return out.select("path", "source", F.col("f.file").alias("file"), via.alias("via"))


def export_maps(decls: DataFrame, reexports: DataFrame) -> DataFrame:
    """(path, name, id, own) of everything a file exports, own declarations first, then re-exports in order.

    decls: path, name, id, visibility, line; reexports: path, pos, file (its resolved source), star, alias, names. A fixed
    point over joins; in a cycle of re-exports every member gets what the others export, whatever the order of files.
    """
    public = decls.where(F.coalesce("visibility", F.lit("public")) != "private")
    own = latest_per(public.select("path", "name", "id", "line"), ["path", "name"], ["line", "id"]).select("path", "name", "id", F.lit(True).alias("own"))
    stars = reexports.where(F.col("star") & F.col("alias").isNull() & F.col("file").isNotNull()).select("path", "pos", "file")
    named = reexports.where(~F.col("star") & F.col("file").isNotNull()).select("path", "pos", "file", F.explode("names").alias("n")).select("path", "pos", "file", F.col("n.local").alias("local"), F.col("n.imported").alias("imported"))
    known = saved(own)
    while True:
        there = known.select(F.col("path").alias("file"), "name", "id")
        more = stars.join(there, "file").select("path", "pos", "name", "id").unionByName(named.join(there.withColumnRenamed("name", "imported"), ["file", "imported"]).select("path", "pos", F.col("local").alias("name"), "id"))
        new = latest_per(more.join(known, ["path", "name"], "left_anti"), ["path", "name"], ["pos", "id"]).select("path", "name", "id", F.lit(False).alias("own"))
        new = saved(new)
        if new.limit(1).count() == 0:
            return known
        known = known.unionByName(new)


def resolve_refs(decls: DataFrame, scopes: DataFrame, specifiers: DataFrame, exports: DataFrame) -> DataFrame:
    """(src, raw, dst, via, reason). decls: id, path, name, refs.

    A name of the same file wins over imports; a name that is in no scope gives no row; equal targets of one source
    count once. via: same-file, import, barrel (through a re-export), alias.
    """
    refs = decls.select(F.col("id").alias("src"), "path", F.explode(F.array_distinct("refs")).alias("raw"))
    local = decls.groupBy("path", F.col("name").alias("raw")).agg(F.min_by("id", "line").alias("own_id"))
    bound = scopes.select("path", F.col("local").alias("raw"), "source", "imported")
    joined = refs.join(local, ["path", "raw"], "left").join(bound, ["path", "raw"], "left").where(F.col("own_id").isNotNull() | F.col("source").isNotNull())
    joined = joined.join(specifiers.select("path", "source", "file", F.col("via").alias("found")), ["path", "source"], "left")
    joined = joined.join(exports.select(F.col("path").alias("file"), F.col("name").alias("imported"), F.col("id").alias("to"), "own"), ["file", "imported"], "left")
    here = F.col("own_id").isNotNull()
    reason = F.when(here, None).when((F.col("imported") == "*") | (F.col("found") == "external"), "external").when(F.col("found") == "unresolved", "unresolved_specifier").when(F.col("to").isNull(), "not_exported")
    via = F.when(here, "same-file").when(F.col("found") == "alias", "alias").when(F.col("own"), "import").otherwise("barrel")
    out = joined.select("src", "raw", F.when(reason.isNull(), F.coalesce("own_id", "to")).alias("dst"), F.when(reason.isNull(), via).alias("via"), reason.alias("reason"))
    good = latest_per(out.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))), ["src", "dst"], ["raw"])
    return good.unionByName(out.where(F.col("reason").isNotNull()))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """One row of counts and the coverage, 1 where nothing was to resolve."""
    good, bad = F.count_if(F.col("dst").isNotNull()), F.count_if(F.col("reason").isNotNull())
    counts = resolved.agg(good.alias("edges_resolved"), bad.alias("edges_unresolved"), F.count_if(F.col("via") == "barrel").alias("barrels_expanded"), F.count_if(F.col("via") == "alias").alias("aliases_resolved"))
    all_ = F.col("edges_resolved") + F.col("edges_unresolved")
    return counts.withColumn("coverage", F.when(all_ == 0, F.lit(1.0)).otherwise(F.bround(F.col("edges_resolved") / all_, 3)))
