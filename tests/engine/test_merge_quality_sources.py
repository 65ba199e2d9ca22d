import json
import os
import time

import pytest
from pyspark.sql import functions as F

from archloom.operators import advisories, layers, merge, quality
from archloom.sinks import documents, mermaid
from archloom.sources import configs, files
from archloom.sources.parse import declarations, low_confidence, normalised, parse_files, resolved_typescript, skipped
from archloom.streaming import ingest

PLAN = "has_prior boolean, extract_version int, prior_extract_version int, refine_version int, prior_refine_version int, base_commit string, has_architecture boolean, is_repo boolean, is_toplevel boolean, is_ancestor boolean, changed int, prior_files int"


def test_plan_reasons(spark):
    good = [True, 2, 2, 1, 1, "abc", True, True, True, True, 3, 10]
    cases = [("incremental", {}), ("no-prior-build", {0: False}), ("extract-version-changed", {2: None}), ("incremental", {1: None, 2: None}), ("refine-version-changed", {4: 9}), ("no-anchor-commit", {5: ""}), ("no-architecture-yml", {6: False}), ("not-a-git-repo", {7: False}), ("root-not-repo-toplevel", {8: None}), ("base-unreachable", {9: False}), ("git-diff-failed", {10: None}), ("too-many-changes", {10: 5}), ("incremental", {10: 5, 11: 0})]
    rows = [tuple(change.get(i, v) for i, v in enumerate(good)) for _, change in cases]
    got = [r.r for r in spark.createDataFrame(rows, PLAN).coalesce(1).select(merge.plan_reason().alias("r")).collect()]
    assert got == [want for want, _ in cases]


def test_merge_and_overlay(spark):
    fresh = spark.createDataFrame([("a", "x.py", "L1", False, []), ("b", "y.py", "L1", True, []), ("n", "z.py", "L2", True, ["t"])], "id string, path string, layer string, core boolean, tags array<string>")
    prior = spark.createDataFrame([("a", "L2", True, ["seen"], "text"), ("b", "L2", True, ["seen"], "text")], "id string, layer string, core boolean, tags array<string>, description string")
    names = spark.createDataFrame([("L1",), ("L2",)], "id string")
    got = {r.id: (r.layer, r.core, r.tags, r.description, r.stale) for r in merge.merge_classes(fresh, prior, spark.createDataFrame([("y.py",)], "path string"), names).collect()}
    assert got == {"a": ("L2", True, ["seen"], "text", False), "b": ("L1", True, [], None, True), "n": ("L2", True, ["t"], None, True)}
    e = spark.createDataFrame([("1", "layer-assignment", "inactive", "a", "L1", None), ("2", "describe", "active", "gone", None, None), ("3", "flow", None, None, None, ["a", "gone"]), ("4", "flow", "active", None, None, []), ("5", "odd", "active", "a", None, None)], "id string, type string, status string, decl_id string, layer_id string, flow_nodes array<string>")
    got = {r.id: (r.status, r.change) for r in merge.reconcile(e, fresh.select("id"), names).collect()}
    assert got == {"1": ("active", "reactivated"), "2": ("inactive", "suspended"), "3": ("inactive", "suspended"), "4": ("active", None), "5": ("inactive", "suspended")}
    base = spark.createDataFrame([("f1", "s", ["a", "b", "c"]), ("f2", "t", ["x"]), ("u1", "q", ["zz"]), ("f3", "", [])], "id string, seed string, nodes array<string>")
    user = spark.createDataFrame([(1, "u1", "", ["a", "b"]), (2, "u2", "t", ["k"]), (3, "u3", "", ["a", "b"])], "ord int, id string, seed string, nodes array<string>")
    assert {(r.id, r.by_user) for r in merge.apply_user_flows(base, user).collect()} == {("f3", False), ("u2", True), ("u3", True)}
    sets = spark.createDataFrame([(i, t) for i, ts in enumerate(("abcde", "abcdf", "abxyz", "abcde")) for t in ts], "id int, token string")
    assert {(r.a, r.b): round(r.similarity, 3) for r in merge.similar_pairs(sets, 0.6).collect()} == {(0, 1): 0.667, (0, 3): 1.0, (1, 3): 0.667}
    assert merge.without_entries(e, e.where("id < '3'").select("id")).count() == 3
    flagged = spark.createDataFrame([(True,), (False,)], "needs_review boolean")
    assert tuple(merge.work_counts(spark.createDataFrame([(True,), (True,)], "stale boolean"), flagged).first()) == (2, 1)
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "id string, ord int")
    assert sorted(r.ord for r in merge.once_per_id(rows, [], ["ord"]).collect()) == [1, 2, 3]


def test_skip_lists_and_pruning(spark, tmp_path):
    names = {r.name for r in files.skip_names(spark, ["# comment", "extra # why", "-docs", "docs2", "-docs2", "docs2"]).collect()}
    assert {"extra", "docs2", "node_modules"} <= names and "docs" not in names
    for p in ("a.py", "src/b.ts", "src/node_modules/c.ts", "app/package.json", "app/build/d.py", "other/build/e.py", "readme.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    os.symlink(tmp_path / "a.py", tmp_path / "z.py")
    os.symlink(tmp_path / "none", tmp_path / "broken.py")
    os.symlink(tmp_path / "src", tmp_path / "linked")
    listed = files.listing(spark, str(tmp_path))
    assert [r.path for r in listed.orderBy("ord").limit(3).collect()] == ["a.py", "readme.txt", "z.py"]
    assert {r.path: r.language for r in files.scan(listed, files.skip_names(spark)).collect()} == {"a.py": "python", "src/b.ts": "typescript", "other/build/e.py": "python"}
    assert {r.ext: r.n for r in files.census(listed).collect()} == {"py": 4, "ts": 2, "json": 1, "txt": 1}
    read = files.read_contents(spark, str(tmp_path / "other"))
    assert read.first().path == "build/e.py" and files.latest_change(read).first()[0] is not None


def test_parsing_and_resolution_end_to_end(spark):
    code = [("src/index.ts", "export * from './widget';\n", "typescript"), ("src/widget.ts", "export class Widget {}\n", "typescript"), ("src/app.ts", "import { Widget } from '@/index';\nexport function boot() { return new Widget(); }\n", "typescript"), ("bad.py", "def (", "python"), ("no.zz", "x", "zz"), ("null.py", None, "python"), ("m.c", "static portTASK( run, p )\n{\n go();\n}\n", "c")]
    parsed = parse_files(spark.createDataFrame(code, "path string, content string, language string")).cache()
    aliases = spark.createDataFrame([("@/*", "src/*", 0, 0)], "pattern string, target string, pattern_pos int, target_pos int")
    refs, rewritten = resolved_typescript(parsed, aliases)
    assert {(r.src, r.dst, r.via) for r in refs.collect()} == {("app.boot", "widget.Widget", "alias")}
    assert {r.id: r.refs for r in rewritten.collect()}["app.boot"] == ["widget.Widget"]
    assert [(r.path, r.reason) for r in skipped(parsed).collect()] == [("bad.py", "exception: SyntaxError")]
    assert [r.id for r in low_confidence(declarations(parsed)).collect()] == ["m.run"]
    odd = spark.createDataFrame([(None, "a/b.py", None, "x"), ("", "", "n", "x")], "id string, path string, namespace string, name string")
    assert [(r.id, r.importance) for r in normalised(odd).collect()] == [("a/b.py", 0.0), ("n.x", 0.0)]


def test_invariants(spark):
    c = spark.createDataFrame([("1", "L", None, "x", True), ("2", "L", "x", "y", True), ("3", "L", None, "x", False), ("4", "M", None, "x", True)], "id string, layer string, display_name string, name string, core boolean")
    assert [(r.layer, r.label, r.ids) for r in quality.duplicate_labels(c).collect()] == [("L", "x", ["1", "2"])]
    assert quality.missing(spark.createDataFrame([("1",), ("9",)], "id string"), c, ["id"]).first().id == "9" and quality.duplicate_ids(c.union(c.where("id = '1'"))).first().id == "1"
    pairs = spark.createDataFrame([("a", "f", "z", None, False), ("b", "f", " ", "e", False), ("c", "f", None, None, False), ("d", "f", None, None, True), ("e", "f", "z", "e", True)], "subject string, field string, zh string, en string, required boolean")
    assert {r.subject: r.state for r in quality.incomplete_pairs(pairs).collect()} == {"a": "missing-en", "b": "missing-zh", "d": "missing-both"}
    a = spark.createDataFrame([(1, 0.1), (2, 0.2), (2, 0.2)], "k int, v double")
    b = spark.createDataFrame([(1, 0.1 + 1e-9), (2, 0.2), (3, 0.3)], "k int, v double")
    assert {(r.k, r.side) for r in quality.changes(a, b).collect()} == {(2, "removed"), (3, "added")}
    assert {tuple(r) for r in quality.violations(inv=pairs.where("subject = 'a'"), other=pairs.where("subject = 'b'")).collect()} == {("inv", "a"), ("other", "b")}
    assert {r.layer: (r.types, r.functions) for r in advisories.kind_counts(spark.createDataFrame([("L", "class"), ("L", "function"), ("M", "enum")], "layer string, kind string")).collect()} == {"L": (1, 1), "M": (1, 0)}


def test_diagrams(spark):
    d = spark.createDataFrame([("ok", 0), ("bad", 1), ("none", 2)], "diagram string, ord int")
    decls = spark.createDataFrame([("m.A",), ("m.B",)], "id string")
    parts = spark.createDataFrame([("ok", 0, "p:a", None, "甲", "A", ["m.A"]), ("ok", 1, "p:u", "actor", "乙", "U", None), ("bad", 0, "q:a", "code", "甲", "", []), ("bad", 1, "p:b", "robot", "甲", "B", ["m.A"]), ("bad", 2, "p:b", "code", "甲", "B", ["m.Z"])], "diagram string, pos int, id string, kind string, name_zh string, name_en string, nodes array<string>")
    steps = spark.createDataFrame([("ok", 0, "p:u", "p:a", None, "去", "go"), ("bad", 0, "p:b", "p:x", "self", "去", "go"), ("bad", 1, "p:b", "p:b", "jump", "", "go")], "diagram string, pos int, src string, dst string, kind string, label_zh string, label_en string")
    errors = quality.validate_sequences(d, parts, steps, decls)
    assert {(r.diagram, r.rule) for r in errors.collect()} == {("bad", x) for x in ("participant-id", "participant-name", "participant-nodes", "participant-kind", "participant-decl", "step-to", "self-step", "step-kind", "step-label")} | {("none", "few-participants"), ("none", "no-steps")}
    assert [(r.diagram, r.is_default) for r in quality.displayable(d, errors).collect()] == [("ok", True)]
    stages = spark.createDataFrame([("ok", 0, "s1", "甲", "A", ["m.A"]), ("ok", 1, "s2", "乙", "B", ["m.B"]), ("bad", 0, "s1", "甲", None, []), ("bad", 1, "s1", "甲", "A", ["m.A", "m.Q", "m.A"])], "diagram string, pos int, id string, name_zh string, name_en string, nodes array<string>")
    extras = spark.createDataFrame([("ok", 0, "x:f", "artifact", "F", "s1"), ("bad", 0, "y", "thing", " ", "s9")], "diagram string, pos int, id string, kind string, name string, stage string")
    links = spark.createDataFrame([("ok", "s1", "m.B", "data", "去", "go"), ("ok", "x:f", "s2", None, "去", "go"), ("bad", "s1", "s7", "odd", "去", None)], "diagram string, src string, dst string, kind string, label_zh string, label_en string")
    nodes = spark.createDataFrame([("ok", "m.A"), ("ok", "m.B"), ("bad", "m.A")], "diagram string, node string")
    got = {(r.diagram, r.rule) for r in quality.validate_pipelines(d, stages, extras, links, nodes, decls).collect()}
    assert got == {("bad", x) for x in ("stage-id", "stage-name", "stage-nodes", "node-not-in-flow", "node-unknown", "node-twice", "extra-id", "extra-kind", "extra-name", "extra-stage", "link-to", "link-label", "link-kind")} | {("none", "no-stages"), ("none", "no-links")}


def test_mermaid():
    pipe = {"type": "pipeline", "stages": [{"id": "s1", "name_zh": "甲", "name_en": 'In "x"', "nodes": ["m.A<T>", "m.B"]}, {"id": "s2", "name_en": "Out", "nodes": ["m.C"]}], "extra_nodes": [{"id": "x:f", "kind": "artifact", "name": "F"}, {"id": "x:u", "kind": "actor", "name": "U"}], "links": [{"from": "s1", "to": "s2", "kind": "control", "label_en": "go"}, {"from": "x:u", "to": "m.B", "label_en": "in"}]}
    text, shown = mermaid.compile_diagram(pipe, {"m.A<T>": "A", "m.C": "C"})
    assert text.split("\n") == ["flowchart LR", '  subgraph n0["In #quot;x#quot;"]', '    n1["A"]', '    n2["m.B"]', "  end", '  subgraph n3["Out"]', '    n4["C"]', "  end", '  n5[/"F"/]', '  n6(["U"])', '  n1 -.->|"go"| n4', '  n6 -->|"in"| n2', '  click n1 call flowClick("m.A<T>")', '  click n2 call flowClick("m.B")', '  click n4 call flowClick("m.C")']
    assert shown == {"n1": "m.A<T>", "n2": "m.B", "n4": "m.C"}
    seq = {"type": "sequence", "participants": [{"id": "p:u", "kind": "actor", "name_en": "User"}, {"id": "p:a", "name_zh": "甲", "nodes": ["m.A"]}], "steps": [{"from": "p:u", "to": "p:a", "label_en": "a;\nb"}, {"from": "p:a", "to": "p:u", "kind": "return", "label_en": "ok"}]}
    assert mermaid.compile_diagram(seq, {})[0].split("\n") == ["sequenceDiagram", "  actor a0 as User", "  participant a1 as 甲", "  a0->>a1: 1. a، b", "  a1-->>a0: 2. ok"]


def test_configs_and_documents(spark, tmp_path):
    (tmp_path / "t.yml").write_text("id: t\nlayers:\n  - id: ui\n    path_segments: [ui, view]\n    name_suffixes: [View]\nsignals:\n  files: [{match: '*.kt', weight: 2}]\n  paths:\n    - match: ui\n")
    (tmp_path / "bad.yml").write_text("id: [")
    (tmp_path / "noid.yml").write_text("layers: []\n")
    t = configs.load_templates(str(tmp_path))
    assert [x["id"] for x in t] == ["t"] and configs.signal_rows(t) == [("t", "file", "*.kt", 2), ("t", "path", "ui", 1)]
    assert configs.layer_rules(t[0]["layers"]) == ([("ui", 0, "ui"), ("ui", 0, "view")], [("ui", 0, "View")])
    assert [x["id"] for x in configs.resolve_layers(str(tmp_path), None, t[0]["layers"])[0]] == ["ui", "uncategorized"]
    (tmp_path / "architecture.yml").write_text("layers:\n  - id: own\n")
    assert configs.resolve_layers(str(tmp_path), None, [])[1] == "architecture.yml"
    (tmp_path / "base.json").write_text('{"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["a/*"]}}}')
    (tmp_path / "tsconfig.json").write_text('{ // c\n "extends": "./base.json", "compilerOptions": {"paths": {"@/*": ["b/*",],},},}')
    assert configs.load_tsconfig(str(tmp_path)) == {"base_url": "src", "paths": {"@/*": ["b/*"]}}
    assert configs.alias_rows({"paths": {"a": ["x", "y"]}}) == [("a", "x", 0, 0), ("a", "y", 0, 1)]
    (tmp_path / "v.json").write_text('{"extract_version": 3, "refine_version": "x"}')
    assert configs.fingerprints(str(tmp_path / "v.json")) == {"extract_version": 3, "refine_version": None} and configs.load_json(str(tmp_path / "none")) is None
    assert configs.git_facts(str(tmp_path))["is_repo"] is False
    layers_ = spark.createDataFrame([("L", 1.0), ("M", 2.0)], "id string, order double")
    classes = spark.createDataFrame([("b", "L", "B"), ("a", "L", None)], "id string, layer string, name string")
    got = {r.id: json.loads(r.doc) for r in documents.layers_document(layers_, classes).collect()}
    assert got == {"L": {"id": "L", "order": 1.0, "classes": [{"id": "a"}, {"id": "b", "name": "B"}]}, "M": {"id": "M", "order": 2.0, "classes": []}}
    documents.write_tables(str(tmp_path / "out"), classes=classes)
    assert files.read_model(spark, str(tmp_path / "out"), "classes")["classes"].count() == 2 and documents.stable_json({"b": 1, "a": 2}).startswith('{\n  "a"')


def test_passes_follow_the_tree(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    names = lambda: sorted(r.name for r in ingest.current(spark, out).collect())
    refresh = lambda: ingest.refresh(spark, str(src), out)
    (src / "a.py").write_text("class A: pass\n")
    (src / "notes.txt").write_text("class X: pass\n")
    assert refresh() == 1 and names() == ["A"] and refresh() == 0
    (src / "b.py").write_text("class B: pass\ndef f(): pass\n")
    assert refresh() == 1 and names() == ["A", "B", "f"]
    (src / "a.py").write_text("class C: pass\nclass D: pass\n")  # rewritten
    assert refresh() == 1 and names() == ["B", "C", "D", "f"]
    (src / "a.py").write_text("")  # emptied: nothing is declared any more
    assert refresh() == 1 and names() == ["B", "f"]
    (src / "b.py").unlink()
    assert refresh() == 1 and names() == [] and refresh() == 0
    (src / "b.py").write_text("class B: pass\n")  # and back again
    assert refresh() == 1 and names() == ["B"]


def test_a_stream_follows_the_tree(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.py").write_text("class A: pass\n")
    query = ingest.follow(spark, str(src), out, str(tmp_path / "mark"), "500 milliseconds")
    try:
        for text, want in (("class A: pass\n", ["A"]), ("class Other: pass\n", ["Other"])):
            (src / "a.py").write_text(text)
            end = time.time() + 60
            while time.time() < end and [r.name for r in ingest.current(spark, out).collect()] != want:
                time.sleep(0.5)
            assert [r.name for r in ingest.current(spark, out).collect()] == want
    finally:
        query.stop()


def test_waiting_and_reading_anew(spark, tmp_path):
    (tmp_path / "d").mkdir()
    path = tmp_path / "d" / "rows.json"
    path.write_text('{"a": 1}\n')
    now = ingest.latest_change(spark, str(tmp_path / "d"))
    assert ingest.wait_for_change(spark, str(tmp_path / "d"), 0) == {"changed": False, "mtime": now}
    assert ingest.wait_for_change(spark, str(tmp_path / "d"), now, 0.3, 0.1) == {"changed": False, "mtime": now}
    read = ingest.reader(spark, str(path))
    assert [r.a for r in read().collect()] == [1]
    path.write_text('{"a": 2}\n{"a": 3}\n')
    os.utime(path, (now + 5, now + 5))
    assert ingest.wait_for_change(spark, str(tmp_path / "d"), now, 5)["changed"]
    assert [r.a for r in read().collect()] == [2, 3]


def test_orders_and_parts_of_a_model(spark):
    edges = spark.createDataFrame([("b", "a", "uses"), ("a", "b", "uses"), ("a", "c", "extends")], "src string, dst string, kind string")
    classes = spark.createDataFrame([("y", "L", ["q", "p"], 0.5), ("x", "L", [], 0.5), ("z", "L", [], 0.9)], "id string, layer string, tags array<string>, importance double")
    flow = spark.createDataFrame([("f", "n2"), ("f", "n1")], "flow string, node string")
    e, c, f = documents.canonical(edges, classes, flow)
    assert [tuple(r) for r in e.collect()] == [("a", "c", "extends"), ("a", "b", "uses"), ("b", "a", "uses")]
    assert [(r.id, r.tags) for r in c.collect()] == [("x", []), ("y", ["p", "q"]), ("z", [])] and [r.node for r in f.collect()] == ["n1", "n2"]
    assert {r.id: r.ord for r in layers.by_importance(classes).collect()} == {"z": 1, "x": 2, "y": 3}
    assert merge.merged_model({"layers": [1], "edges": [], "layer_groups": [2]}, flows=[3]) == {"layers": [1], "edges": [], "flows": [3]}
    boxes = spark.createDataFrame([("L", 1, "a", 60.0), ("L", 2, "b", 60.0), ("L", 3, "c", 30.0)], "layer string, ord int, id string, w double")
    sizes = layers.Sizes(node_height=10, gap_x=5, gap_y=2, pad_x=8, pad_top=20, pad_bottom=4, band_gap=6)
    bands, nodes = layers.bands(spark.createDataFrame([("L", 0), ("M", 1)], "id string, ord int"), boxes, 120, sizes)
    assert {r.id: (r.y, r.height) for r in bands.collect()} == {"L": (0.0, 46.0), "M": (52.0, 24.0)}
    assert {r.id: (r.x, r.y) for r in nodes.collect()} == {"a": (8.0, 20.0), "b": (8.0, 32.0), "c": (73.0, 32.0)}


def test_default_lists():
    from archloom import config

    assert len(config.SKIP_DIRS) == 61 and {"third_party", "Carthage", "commonTest", "jvmTest", "androidTest", "assets", "mock", "demo", ".mypy_cache", "build"} <= set(config.SKIP_DIRS) and "docs" not in config.SKIP_DIRS
    assert {"settings.gradle", "build.xml", "setup.cfg", "build.sbt", "BUILD"} <= set(config.BUILD_MANIFESTS) and not {"go.mod", "Package.swift"} & set(config.BUILD_MANIFESTS)
    segments = {x["id"]: x["path_segments"] for x in config.DEFAULT_LAYERS}
    assert {"handlers", "endpoints"} <= set(segments["presentation"]) and "logic" in segments["domain"] and {"persistence", "remote"} <= set(segments["data"]) and {"lib", "net", "cmd"} <= set(segments["infrastructure"])


def test_a_model_without_some_tables(spark, tmp_path):
    documents.write_tables(str(tmp_path), edges=spark.createDataFrame([("a", "b", "uses")], files.MODEL["edges"]))
    got = files.read_model(spark, str(tmp_path))
    assert set(got) == set(files.MODEL) and got["edges"].count() == 1 and got["skipped"].count() == 0


@pytest.mark.parametrize("glob, yes, no", [("*.csproj", "a.csproj", "a.csproj.x"), ("req?.txt", "req1.txt", "req.txt"), ("*", "a", ".hidden"), (".*", ".hidden", "a")])
def test_globs(glob, yes, no):
    import re

    assert re.match(configs.glob_pattern(glob), yes) and not re.match(configs.glob_pattern(glob), no)
