"""K1-K5: the model as tables, and as one nested document where a reader wants it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(folder: str, **frames: DataFrame) -> None:
    """K1: each frame as Parquet under its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def layers_document(layers: DataFrame, classes: DataFrame) -> DataFrame:
    """K2: (id, doc): each layer with its classes, sorted by id, as JSON without null fields."""
    body = classes.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in classes.columns if c not in ("id", "layer")]))).alias("classes"))
    joined = layers.join(body.withColumnRenamed("layer", "id"), "id", "left")
    whole = F.struct(*[F.col(c) for c in layers.columns], F.coalesce("classes", F.array().cast(body.schema["classes"].dataType)).alias("classes"))
    return joined.select("id", F.to_json(whole).alias("doc"))


def write_lines(df: DataFrame, path: str) -> None:
    """K3, K4: rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def stable_json(value) -> str:
    """K5: keys sorted, two spaces, a line feed at the end."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def canonical(edges: DataFrame, classes: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables in an order that doesn't depend on how they came about: edges (src, dst, kind) by src, kind and dst,
    classes by layer and id, else name, with sorted tags and supertypes, flows (flow, node and more) by flow and node."""
    inner = [c for c in ("tags", "supertypes") if c in classes.columns]
    for c in inner:
        classes = classes.withColumn(c, F.array_sort(c))
    return edges.orderBy("src", "kind", "dst"), classes.orderBy("layer", F.coalesce(*[F.col(c) for c in ("id", "name") if c in classes.columns])), flows.orderBy("flow", "node")
