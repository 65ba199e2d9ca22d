"""Layers: classification by rules, group expansion, template scores and fit.

Rules are small tables: (layer, layer_pos, segment) and (layer, layer_pos, suffix); they are the broadcast side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archloom.config import UNCATEGORIZED
from archloom.functions.text import filled


def assign_layers(decls: DataFrame, segment_rules: DataFrame, suffix_rules: DataFrame) -> DataFrame:
    """Adds layer. decls: id, name, path, namespace.

    Segments of path and namespace in lower case, the last first; the first that a rule names decides, by the order of
    layers where several name it. Else the first layer with a suffix of the name; else uncategorized.
    """
    namespace = F.filter(F.split(F.replace(F.coalesce("namespace", F.lit("")), F.lit("::"), F.lit(".")), r"\."), lambda s: s != "")
    segments = F.reverse(F.transform(F.concat(F.split(F.coalesce("path", F.lit("")), "/"), namespace), lambda s: F.lower(s)))
    keyed = decls.select("id", F.posexplode(segments).alias("at", "segment")).distinct()
    rules = F.broadcast(segment_rules.select(F.lower("segment").alias("segment"), "layer", "layer_pos"))
    by_segment = keyed.join(rules, "segment").groupBy("id").agg(F.min_by("layer", F.struct("at", "layer_pos")).alias("l1"))
    named = decls.select("id", "name").distinct().join(F.broadcast(suffix_rules.select("suffix", F.col("layer").alias("l"), "layer_pos")), F.expr("endswith(name, suffix)"))
    by_suffix = named.groupBy("id").agg(F.min_by("l", "layer_pos").alias("l2"))
    out = decls.join(by_segment, "id", "left").join(by_suffix, "id", "left")
    return out.withColumn("layer", F.coalesce("l1", "l2", F.lit(UNCATEGORIZED))).drop("l1", "l2")


def expand_groups(config: DataFrame) -> DataFrame:
    """L2: leaves (id, order, grp) of entries (id, pos, order, layout, children array<string>, null for a leaf).

    A leaf keeps its order; a row's children take their group's rank, a column's the steps between it and the next.
    """
    t = F.coalesce(F.col("order").cast("double"), F.col("pos").cast("double"))
    leaf = config.where(F.col("children").isNull()).select("id", F.col("order").cast("double").alias("order"), F.lit(None).cast("string").alias("grp"))
    inner = config.where(F.col("children").isNotNull()).select(F.col("id").alias("grp"), "layout", t.alias("t"), F.size("children").alias("m"), F.posexplode("children").alias("j", "id"))
    order = F.when(F.col("layout") == "column", F.col("t") + (F.col("j") + 1) / (F.col("m") + 1)).otherwise(F.col("t"))
    return leaf.unionByName(inner.select("id", order.alias("order"), "grp"))


def template_fit(decls: DataFrame, layers: DataFrame) -> DataFrame:
    """A10: one row on how the layers (id) took up the declarations (layer)."""
    counts = decls.groupBy("layer").agg(F.count("*").alias("n"))
    real = layers.where(F.col("id") != UNCATEGORIZED).select(F.col("id").alias("layer")).distinct().join(counts, "layer", "left")
    own = real.agg(F.count("*").alias("total_layers"), F.count_if(F.col("n").isNull()).alias("empty_layers"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("layer") == UNCATEGORIZED, F.col("n"))), F.lit(0)).alias("uncat"))
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total"), 3)).otherwise(F.lit(0.0))
    out = own.crossJoin(total).select("total", "total_layers", "empty_layers", share("uncat").alias("uncategorized_pct"), share("largest").alias("largest_layer_pct"))
    unfit = (F.col("total") >= 20) & ((F.col("uncategorized_pct") >= 0.25) | ((F.col("empty_layers") >= 2) & (F.col("largest_layer_pct") >= 0.6)))
    return out.withColumn("fits", ~unfit)


def template_scores(files: DataFrame, manifests: DataFrame, dirs: DataFrame, signals: DataFrame) -> DataFrame:
    """(template, score). files: path; manifests: text; dirs: dir; signals: template, kind, match, weight.

    A file signal (a pattern with * and ?) counts for each file of that name; a dependency once if a manifest holds it;
    a path up to three times for the directories that are it or end with it.
    """
    rule = lambda kind: F.broadcast(signals.where(F.col("kind") == kind))
    name = files.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.replace(F.col("match"), F.lit("."), F.lit("\\.")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))
    by_file = name.join(rule("file"), F.regexp_like(F.col("name"), pattern)).groupBy("template", "match", "weight").agg(F.count("*").alias("n")).select("template", (F.col("n") * F.col("weight")).alias("s"))
    by_dependency = manifests.join(rule("dependency"), F.contains("text", "match")).select("template", "match", "weight").distinct().select("template", F.col("weight").alias("s"))
    ends = (F.col("dir") == F.col("match")) | F.endswith("dir", F.concat(F.lit("/"), F.col("match")))
    by_path = dirs.select("dir").distinct().join(rule("path"), ends).groupBy("template", "match", "weight").agg(F.count("*").alias("n")).select("template", (F.least("n", F.lit(3)) * F.col("weight")).alias("s"))
    scored = by_file.unionByName(by_dependency).unionByName(by_path).groupBy("template").agg(F.sum("s").cast("long").alias("score"))
    return signals.select("template").distinct().join(scored, "template", "left").select("template", F.coalesce("score", F.lit(0)).alias("score"))


def choose_template(scores: DataFrame, default: str = "clean-architecture") -> DataFrame:
    """The best score; of equals the default, else the first by name."""
    return scores.orderBy(F.desc("score"), F.desc(F.col("template") == default), "template").limit(1)


def glob_pattern(glob: str) -> str:
    """A regular expression for one path segment; hidden names only match a pattern that starts with a dot."""
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() else c for c in glob)
    return ("^" if glob.startswith(".") else "^(?!\\.)") + body + "$"


def directory_closure(paths: DataFrame) -> DataFrame:
    """Every directory above the files (path)."""
    parts = F.split("path", "/")
    each = paths.select(parts.alias("p")).where(F.size("p") > 1)
    return each.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", 1, k), "/"))).alias("dir")).where(filled(F.col("dir")).isNotNull()).distinct()


def core_view(classes: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The core rows, and the layers (id) that hold some."""
    some = classes.where("core")
    return some, layers.join(some.select(F.col("layer").alias("id")).distinct(), "id", "left_semi")


def top_evidence(scores: DataFrame, n: int = 3) -> DataFrame:
    """The n best scores."""
    return scores.orderBy(F.desc("score"), "template").limit(n)


def rollup(decls: DataFrame) -> DataFrame:
    """Extension: counts by language, layer and kind with all totals."""
    return decls.rollup("language", "layer", "kind").agg(F.count("*").alias("n"))


def pack_rows(boxes: DataFrame, width: float, gap: float = 0.0) -> DataFrame:
    """Greedy rows of boxes (layer, ord, id, w), a new row where the next box doesn't fit. Adds row.

    Each layer is folded in its order by an aggregate over its widths.
    """
    rows = boxes.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "w"))).alias("b"))
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("out"))

    def place(a, b):
        fits = (a["used"] == 0) | (a["used"] + gap + b["w"] <= width)
        row = F.when(fits, a["row"]).otherwise(a["row"] + 1)
        used = F.when(fits & (a["used"] > 0), a["used"] + gap + b["w"]).otherwise(b["w"].cast("double"))
        return F.struct(row.alias("row"), used.alias("used"), F.concat(a["out"], F.array(row)).alias("out"))

    placed = rows.select("layer", "b", F.aggregate("b", start, place)["out"].alias("r"))
    return placed.select("layer", F.explode(F.arrays_zip("b", "r")).alias("x")).select("layer", F.col("x.b.id").alias("id"), F.col("x.r").alias("row"))


def by_importance(classes: DataFrame, layer: str = "layer") -> DataFrame:
    """Adds ord: a row's place in its layer, by importance, then id."""
    return classes.withColumn("ord", F.row_number().over(W.partitionBy(layer).orderBy(F.desc("importance"), "id")))


@dataclass(frozen=True)
class Sizes:
    """Measures of a drawing, in pixels."""

    node_height: float = 28.0
    gap_x: float = 12.0
    gap_y: float = 10.0
    pad_x: float = 16.0
    pad_top: float = 34.0
    pad_bottom: float = 14.0
    band_gap: float = 18.0


def bands(layers: DataFrame, boxes: DataFrame, width: float, sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """K8: (bands, nodes): bands (id, x, y, width, height) under each other in the order of layers (id, ord), and the place
    (layer, id, x, y, w, h) of every box (layer, ord, id, w) in its layer's rows. Layers are few; a window without key
    runs over them alone."""
    packed = pack_rows(boxes, width - 2 * sizes.pad_x, sizes.gap_x).join(boxes.select("layer", "id", "ord", "w"), ["layer", "id"])
    rows = layers.join(packed.groupBy(F.col("layer").alias("id")).agg((F.max("row") + 1).alias("rows")), "id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    content = F.when(F.col("rows") > 0, F.col("rows") * F.lit(sizes.node_height) + (F.col("rows") - 1) * F.lit(sizes.gap_y)).otherwise(F.lit(0.0))
    tall = rows.withColumn("height", content + F.lit(sizes.pad_top + sizes.pad_bottom))
    above = W.orderBy("ord", "id").rowsBetween(W.unboundedPreceding, -1)
    placed = tall.select("id", F.lit(0.0).alias("x"), F.coalesce(F.sum(F.col("height") + F.lit(sizes.band_gap)).over(above), F.lit(0.0)).alias("y"), F.lit(float(width)).alias("width"), "height")
    before = W.partitionBy("layer", "row").orderBy("ord", "id").rowsBetween(W.unboundedPreceding, -1)
    x = F.lit(sizes.pad_x) + F.coalesce(F.sum(F.col("w") + F.lit(sizes.gap_x)).over(before), F.lit(0.0))
    nodes = packed.withColumn("x", x).join(placed.select(F.col("id").alias("layer"), F.col("y").alias("top")), "layer")
    y = F.col("top") + F.lit(sizes.pad_top) + F.col("row") * F.lit(sizes.node_height + sizes.gap_y)
    return placed, nodes.select("layer", "id", "x", y.alias("y"), "w", F.lit(sizes.node_height).alias("h"))


def latest_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") == 1).drop("_r")
