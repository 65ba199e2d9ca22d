"""Display names: labels that tell apart declarations of the same name.

Groups of one name may be large, so nothing is gathered: a group's shared beginning is that of its least and greatest
segment lists, its shared end the same on reversed lists, and the rest are counts over windows or groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archloom.config import DEFAULT, GENERIC_NAMES, EngineConfig
from archloom.functions.text import context_segments, filled, qualified_name, signature_parts


def shared_length(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.get(a, i - 1) != F.get(b, i - 1)))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, n)


def last(segments: Column, k: Column) -> Column:
    n = F.size(segments)
    return F.slice(segments, F.greatest(n - k + 1, F.lit(1)), F.least(k, n))


def distinguishers(decls: DataFrame, cap: int = 2) -> DataFrame:
    """Adds dist for rows whose name is shared. decls: key (unique), name, segments."""
    by = decls.groupBy("name").agg(
        F.count("*").alias("n"), F.min("segments").alias("lo"), F.max("segments").alias("hi"),
        F.min(F.reverse("segments")).alias("rlo"), F.max(F.reverse("segments")).alias("rhi"), F.min(F.size("segments")).alias("least"),
    ).where(F.col("n") > 1)
    prefix = shared_length(F.col("lo"), F.col("hi"))
    by = by.withColumn("p", prefix).withColumn("s", F.least(shared_length(F.col("rlo"), F.col("rhi")), F.col("least") - F.col("p"))).select("name", "n", "p", "s")
    own = decls.join(by, "name")
    middle = F.slice("segments", F.col("p") + 1, F.greatest(F.size("segments") - F.col("p") - F.col("s"), F.lit(0)))
    own = own.withColumn("mid", F.when(F.size(middle) > 0, middle).otherwise(last(F.col("segments"), F.lit(1))))
    long = own.groupBy("name").agg(F.max(F.size("mid")).alias("longest"), F.max(F.size("segments")).alias("most")).where(F.col("longest") > cap).select("name", "most")
    tails = own.join(long, "name").select("name", "n", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("k"), "segments")
    tails = tails.select("name", "n", "k", F.array_join(last(F.col("segments"), F.col("k")), "/").alias("tail"))
    shortest = tails.groupBy("name", "n", "k").agg(F.countDistinct("tail").alias("d")).where(F.col("d") == F.col("n")).groupBy("name").agg(F.min("k").alias("k"))
    dist = F.when(F.col("k").isNotNull(), F.array_join(last(F.col("segments"), F.col("k")), "/")).otherwise(F.array_join("mid", "/"))
    return own.join(shortest, "name", "left").select("key", "n", dist.alias("dist"))


def display_names(decls: DataFrame, config: EngineConfig = DEFAULT, overloads: bool = True) -> DataFrame:
    """Adds display_name, null where the bare name is enough. decls: key (unique), name, namespace, path, signature.

    Four repairs follow one another, each on the labels that still stand twice after the one before.
    """
    base = decls.withColumn("segments", context_segments(F.col("namespace"), F.col("path")))
    dist = distinguishers(base.select("key", "name", "segments"))
    fanout = F.col("name").isin(*GENERIC_NAMES) & (F.col("n") >= config.fanout_threshold)
    named = F.when(F.col("dist") != "", F.concat_ws(":", "dist", "name")).otherwise(F.col("name"))
    out = base.drop("segments").join(dist, "key", "left")
    out = out.withColumn("label", F.when(F.col("n").isNull(), F.col("name")).when(fanout, F.col("dist")).otherwise(named))
    twice = F.count("*").over(W.partitionBy("label")) > 1
    qname = qualified_name(F.col("namespace"), F.col("name"))
    out = out.withColumn("label", F.when(twice, F.coalesce(named, F.col("name"))).otherwise(F.col("label")))
    out = out.withColumn("label", F.when(twice, qname).otherwise(F.col("label")))
    if overloads:
        out = compact_overloads(out)
    signature = filled(F.trim(F.coalesce("signature", F.lit(""))))
    out = out.withColumn("label", F.when(twice, F.concat_ws(" ", qname, signature)).otherwise(F.col("label")))
    return out.withColumn("display_name", F.when(F.col("label") != F.col("name"), F.col("label"))).drop("label", "n", "dist")


def compact_overloads(labelled: DataFrame) -> DataFrame:
    """Labels that stand twice become name and the least part of the signature that separates them: return type,
    else parameters, else both; a group with a signature that can't be read stays."""
    tally = labelled.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    parts = labelled.join(tally, "label").withColumn("_p", signature_parts("signature", "name"))
    selector, returned = F.col("_p.selector"), F.col("_p.returned")
    arrow = F.concat_ws(" → ", "name", returned)
    call = F.concat(F.col("name"), F.lit("("), selector, F.lit(")"))
    both = F.concat(call, F.lit(" → "), returned)
    groups = parts.groupBy("label").agg(
        F.every(F.col("_p.ok")).alias("ok"), F.every(returned != "").alias("full"),
        F.countDistinct(returned).alias("dr"), F.countDistinct(selector).alias("ds"), F.countDistinct(F.concat_ws(" ", selector, returned)).alias("db"),
    )
    chosen = parts.select("key", "label", "_n", arrow.alias("_r"), call.alias("_s"), both.alias("_b")).join(groups, "label")
    pick = F.when(~F.col("ok"), None).when(F.col("full") & (F.col("dr") == F.col("_n")), F.col("_r")).when(F.col("ds") == F.col("_n"), F.col("_s")).when(F.col("db") == F.col("_n"), F.col("_b"))
    return labelled.join(chosen.select("key", pick.alias("_c")), "key", "left").withColumn("label", F.coalesce("_c", "label")).drop("_c")
