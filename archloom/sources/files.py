"""Source trees as tables: scan, census, pruning, manifests, skip lists."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.config import BUILD_MANIFESTS, OTHER_LANGUAGES, OUTPUT_DIRS, SKIP_DIRS, STATE_DIR
from archloom.operators.layers import directory_closure, latest_per
from archloom.operators.merge import last_wins

#: Extensions of the languages that are read.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "c++": "cpp", "h++": "cpp", "cs": "csharp",
    "swift": "swift", "m": "objc", "mm": "objc", "lua": "lua", "dart": "dart",
}


def extension(path):
    """Text after the last dot of the file's name."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def pruned(paths: DataFrame, skip: DataFrame, manifest_dirs: DataFrame) -> DataFrame:
    """Rows (path) without a skipped folder above them. skip: name; manifest_dirs: dir with a build manifest.

    An output folder (build, out, dist, target) that is to be skipped only is where its parent has a manifest.
    """
    dirs = directory_closure(paths.select("path")).select("dir", F.element_at(F.split("dir", "/"), -1).alias("name"), F.regexp_replace("dir", "(^|/)[^/]*$", "").alias("parent"))
    dirs = dirs.join(F.broadcast(skip.select("name")), "name", "left_semi")
    outputs = F.col("name").isin(*OUTPUT_DIRS)
    skipped = dirs.where(~outputs).select("dir")
    built = dirs.where(outputs).join(manifest_dirs.select(F.col("dir").alias("parent")), "parent", "left_semi").select("dir")
    gone = skipped.union(built).distinct()
    above = paths.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("dir"))
    hit = above.where("dir <> path").join(gone, "dir", "left_semi").select("path").distinct()
    return paths.join(hit, "path", "left_anti")


def manifest_dirs(paths: DataFrame) -> DataFrame:
    """Folders that hold a build manifest."""
    name = F.element_at(F.split("path", "/"), -1)
    return paths.where(name.isin(*BUILD_MANIFESTS)).select(F.regexp_replace("path", "(^|/)[^/]*$", "").alias("dir")).distinct()


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, realpath, ord) of a local tree: files of a folder before its folders, each by name; links to folders aren't
    followed, broken links and unreadable folders are left out."""
    rows: list[tuple[str, str, int]] = []

    def walk(folder: str, relative: str) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.is_file() and os.path.exists(e.path):
                rows.append((relative + e.name, os.path.realpath(e.path), len(rows)))
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                walk(e.path, f"{relative}{e.name}/")

    walk(root, "")
    return spark.createDataFrame(rows, "path string, realpath string, ord long")


def scan(files: DataFrame, skip: DataFrame) -> DataFrame:
    """Files (path, realpath, ord) of known languages, pruned, one for each real path. Adds language."""
    known = files.sparkSession.createDataFrame(list(LANGUAGES.items()), "ext string, language string")
    kept = pruned(files, skip, manifest_dirs(files)).withColumn("ext", extension("path")).join(F.broadcast(known), "ext")
    return latest_per(kept, ["realpath"], ["ord"]).drop("ext")


def census(files: DataFrame) -> DataFrame:
    """(ext, n) of all files, of any kind."""
    return files.select(extension("path").alias("ext")).where("ext <> ''").groupBy("ext").agg(F.count("*").alias("n"))


def read_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every file below a folder that Spark reads, with paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inside = F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in folder.rstrip("/").removeprefix("file://")) + "/", "")
    return raw.select(inside.alias("path"), F.decode("content", "UTF-8").alias("content"), "modificationTime")


def skip_names(spark: SparkSession, lines: list[str] | None = None) -> DataFrame:
    """Names to skip after a list's lines."""
    rows = spark.createDataFrame(list(enumerate(lines or [])), "ord int, line string")
    return last_wins(rows, list(SKIP_DIRS))


def latest_change(contents: DataFrame) -> DataFrame:
    """One row with the last modification among files."""
    return contents.agg(F.max("modificationTime").alias("modificationTime"))


#: Tables of an extract and what stands for one that isn't there.
MODEL = {
    "declarations": "id string, name string, namespace string, path string, line int, kind string, language string, visibility string, supertypes array<string>, refs array<string>, confidence string",
    "edges": "src string, dst string, kind string",
    "resolution": "src string, raw string, dst string, via string, reason string",
    "skipped": "path string, line int, reason string",
    "advisories": "kind string, dir string, declarations long, foreign long, foreign_pct double, dominant_foreign string, language string, files long",
    "namespaces": "namespace string, n long",
    "template_scores": "template string, score long",
}


def read_model(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a model as write_tables left them; one of MODEL that was not written is empty."""
    out = {}
    for name in names or MODEL:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            if name not in MODEL:
                raise
            out[name] = spark.createDataFrame([], MODEL[name])
    return out


def unread_languages(spark: SparkSession) -> DataFrame:
    """(ext, language) of known languages without a reader."""
    return spark.createDataFrame(list(OTHER_LANGUAGES.items()), "ext string, language string")


def skip_lines(root: str) -> list[str]:
    """The lines of a project's own skip list; none if it has none."""
    try:
        with open(os.path.join(root, STATE_DIR, "skip-dirs.txt"), encoding="utf-8") as f:
            return f.read().split("\n")
    except OSError:
        return []


def manifest_rows(root_files: DataFrame, contents: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(path, text) of manifests of the given names in the root and the folders of a pruned listing (path)."""
    name, depth = F.element_at(F.split("path", "/"), -1), F.size(F.split("path", "/"))
    return root_files.where(name.isin(*names) & (depth <= 2)).select("path").join(contents.select("path", F.col("content").alias("text")), "path")
