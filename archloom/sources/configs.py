"""Small files that steer a run, read on the driver: YAML layers and templates, tsconfig, versions, git facts."""

from __future__ import annotations

import json
import math
import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from archloom.config import REST_LAYER, SKIP_DIRS, UNCATEGORIZED
from archloom.operators.layers import glob_pattern

#: Manifests of the root that are read for dependencies, and patterns of more in it and the folders below.
MANIFESTS = (
    "package.json", "go.mod", "Cargo.toml", "pyproject.toml",
    "requirements.txt", "requirements-dev.txt",
    "build.gradle", "build.gradle.kts", "app/build.gradle", "app/build.gradle.kts",
    "pom.xml", "Gemfile", "composer.json",
)
MANIFEST_GLOBS = ("*.csproj", "*.vcxproj", "Package.swift", "pubspec.yaml", "CMakeLists.txt")


def load_yaml(text: str):
    """S7."""
    import yaml

    return yaml.safe_load(text)


def load_json(path: str):
    """A document, or None on any error."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def load_templates(folder: str) -> list[dict]:
    """Templates of a folder by file name; those without id or layers, or that can't be read, are left out."""
    found = []
    for path in sorted(Path(folder).glob("*.yml")):
        try:
            one = load_yaml(path.read_text(encoding="utf-8"))
        except Exception:  # noqa: BLE001  a bad template must not end the run
            continue
        if isinstance(one, dict) and one.get("id") and one.get("layers"):
            found.append({**one, "signals": one.get("signals") or {}})
    return found


def signal_rows(templates: list[dict]) -> list[tuple[str, str, str, int]]:
    """(template, kind, match, weight) for template_scores."""
    kinds = {"files": "file", "dependencies": "dependency", "paths": "path"}
    return [(t["id"], kinds[k], str(s["match"]), int(s.get("weight", 1))) for t in templates for k in kinds for s in t["signals"].get(k) or []]


def layer_rules(layers: list[dict]) -> tuple[list[tuple[str, int, str]], list[tuple[str, int, str]]]:
    """(layer, layer_pos, segment) and (layer, layer_pos, suffix) rows of a layer list."""
    segments = [(layer["id"], i, s) for i, layer in enumerate(layers) for s in layer.get("path_segments") or []]
    return segments, [(layer["id"], i, s) for i, layer in enumerate(layers) for s in layer.get("name_suffixes") or []]


def resolve_layers(root: str, detected: list[dict] | None, default: list[dict]) -> tuple[list[dict], str]:
    """L1: layers of architecture.yml or .json in a folder, else of the detected template, else the default; and where from."""
    for name in ("architecture.yml", "architecture.json"):
        path = Path(root) / name
        try:
            text = path.read_text(encoding="utf-8")
            layers = (json.loads(text) if name.endswith("json") else load_yaml(text) or {}).get("layers")
        except Exception:  # noqa: BLE001  a broken file counts as none
            continue
        if isinstance(layers, list) and layers:
            return with_rest(layers), name
    return (with_rest(detected), "template") if detected else (with_rest(default), "default")


def with_rest(layers: list[dict]) -> list[dict]:
    return layers if any(x.get("id") == UNCATEGORIZED for x in layers) else [*layers, REST_LAYER]


def manifest_text(root: str) -> str:
    """The manifests of a root in one text: the named ones, then those of the patterns there and in its folders."""
    base = Path(root)
    below = sorted(p for p in base.iterdir() if p.is_dir() and p.name not in SKIP_DIRS)
    paths = [base / name for name in MANIFESTS]
    for glob in MANIFEST_GLOBS:
        pattern = re.compile(glob_pattern(glob))
        paths += [p for folder in (base, *below) for p in sorted(folder.iterdir()) if pattern.match(p.name)]
    found = [p.read_text(encoding="utf-8", errors="replace") for p in dict.fromkeys(paths) if p.is_file()]
    return "\n".join(found)


def plain_json(text: str):
    """P17 and parse: JSON with comments and trailing commas."""
    text = re.sub(r"/\*[\s\S]*?\*/", "", text)
    text = re.sub(r"(?m)(^|[^:\"])//.*$", r"\1", text)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", text))


def load_tsconfig(root: str, most: int = 10) -> dict:
    """base_url and paths after relative `extends`, nearest file last; jsconfig.json if tsconfig.json has neither."""
    for name in ("tsconfig.json", "jsconfig.json"):
        chain, path, seen = [], Path(root) / name, set()
        while len(chain) < most and path not in seen and path.is_file():
            seen.add(path)
            try:
                one = plain_json(path.read_text(encoding="utf-8"))
            except ValueError:
                break
            chain.append((path.parent, one))
            parent = one.get("extends")
            if not isinstance(parent, str) or not parent.startswith("."):
                break
            path = Path(os.path.normpath(path.parent / (parent if parent.endswith(".json") else parent + ".json")))
        out: dict = {"base_url": None, "paths": {}}
        for folder, one in reversed(chain):
            options = one.get("compilerOptions") or {}
            if options.get("baseUrl") is not None:
                out["base_url"] = os.path.relpath(folder / options["baseUrl"], root)
            out["paths"] |= options.get("paths") or {}
        if out["base_url"] is not None or out["paths"]:
            return out
    return {"base_url": None, "paths": {}}


def alias_rows(config: dict) -> list[tuple[str, str, int, int]]:
    """(pattern, target, pattern_pos, target_pos) for resolve_specifiers."""
    return [(p, t, i, j) for i, (p, ts) in enumerate(config["paths"].items()) for j, t in enumerate(ts)]


def fingerprints(path: str) -> dict[str, int | None]:
    """Two finite numbers or None."""
    one = load_json(path) or {}
    number = lambda v: int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else None
    return {k: number(one.get(k)) for k in ("extract_version", "refine_version")}


def _git(root: str, *arguments: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=15)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def git_facts(root: str, base: str | None = None) -> dict:
    """What git says of a folder; None or False where it can't tell."""
    top = (_git(root, "rev-parse", "--show-toplevel") or "").strip()
    commit = (_git(root, "rev-parse", "HEAD") or "").strip() or None
    changed = None
    if base:
        diff, status = _git(root, "diff", "--name-only", base), _git(root, "status", "--porcelain")
        if diff is not None and status is not None:
            lines = [re.sub('^"|"$', "", x[3:].split(" -> ")[-1].strip()) for x in status.split("\n") if x.strip()]
            changed = sorted({*filter(None, diff.split("\n")), *filter(None, lines)})
    return {
        "is_repo": bool(top), "is_toplevel": bool(top) and os.path.realpath(top) == os.path.realpath(root), "commit": commit, "short": commit[:7] if commit else None,
        "branch": (_git(root, "rev-parse", "--abbrev-ref", "HEAD") or "").strip() or None, "dirty": bool((_git(root, "status", "--porcelain") or "").strip()),
        "is_ancestor": bool(base) and _git(root, "merge-base", "--is-ancestor", base, "HEAD") is not None, "changed": changed,
    }


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A rule table; it may be empty."""
    return spark.createDataFrame(values, schema)
