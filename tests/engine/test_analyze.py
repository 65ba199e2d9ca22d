from archloom.operators import flows
from archloom.plans.analyze import analyze


def test_a_small_project_end_to_end(spark, tmp_path):
    code = {
        "app.py": "def main():\n    helper_a()\n    helper_b()\n\ndef helper_a():\n    pass\n\ndef helper_b():\n    helper_a()\n",
        "ui/home.ts": "import { OrderService } from '@/index';\nexport class HomeView {\n  show() { return new OrderService(); }\n}\n",
        "src/index.ts": "export * from './order';\n",
        "src/order.ts": "export class OrderService extends Base {}\nexport class OtherService extends Base {}\n",
        "node_modules/x.ts": "export class Hidden {}\n",
        "bad.py": "def (\n",
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}',
    }
    for path, text in code.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = analyze(spark, str(tmp_path))
    classes = {r.id: r for r in got["classes"].collect()}
    assert set(classes) == {"app.main", "app.helper_a", "app.helper_b", "ui.home.HomeView", "order.OrderService", "order.OtherService"}
    assert {(r.src, r.dst) for r in got["edges"].collect()} == {("app.main", "app.helper_a"), ("app.main", "app.helper_b"), ("app.helper_b", "app.helper_a"), ("ui.home.HomeView", "order.OrderService")}
    assert classes["ui.home.HomeView"].layer == "presentation" and classes["order.OrderService"].layer == "domain" and classes["app.main"].core
    assert flows.frames(got["flows"])["flow:app.main"] == ["app.main", "app.helper_a", "app.helper_b"]
    assert {(r.key, r.impl) for r in got["dispatch"].collect()} == {("Base", "order.OrderService"), ("Base", "order.OtherService")}
    assert {r.reason for r in got["skipped"].collect()} == {"exception: SyntaxError"}
    assert {r.language: r.n for r in got["languages"].collect()} == {"python": 3, "typescript": 3}
    assert got["detection"].first().asDict() == {"chosen": "clean-architecture", "origin": "default", "reason": "no-plugin-root"}
    flow = [(r.src_order, r.flow, r.seed_kind) for r in got["flow_list"].orderBy("src_order", "ord").collect()]
    assert ("flow:app.main", "entry-point") in [f[1:] for f in flow] and flow == sorted(flow, key=lambda f: f[0])
    assert got["advisories"].count() == 0


TEMPLATE = "id: {id}\nlayers:\n  - id: {layer}\n    path_segments: [{segment}]\nsignals:\n  dependencies: [{{match: '{dependency}', weight: 3}}]\n  paths: [{{match: {segment}, weight: 1}}]\n"


def test_templates_and_advisories_of_a_tree(spark, tmp_path):
    root, templates = tmp_path / "p", tmp_path / "templates"
    templates.mkdir()
    (templates / "one.yml").write_text(TEMPLATE.format(id="one", layer="screens", segment="ui", dependency="compose"))
    (templates / "two.yml").write_text(TEMPLATE.format(id="two", layer="systems", segment="ecs", dependency="bevy"))
    code = {
        "build.gradle": 'android { namespace = "com.own.app" }\nimplementation "compose"\n',
        "ui/Home.kt": "package com.own.app\nclass Home {\n}\n",
        "own/main.py": "def main():\n    pass\n",
        "skipped/x.py": "class Hidden: pass\n",
        ".archloom/skip-dirs.txt": "# ours\nskipped  # not code\n-demo\n",
        "demo/d.py": "class Shown: pass\n",
        **{f"big/F{i}.kt": f"package org.other.lib\nclass F{i} {{\n}}\n" for i in range(55)},
        **{f"scripts/s{i}.sh": "" for i in range(60)},
    }
    for path, text in code.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    got = analyze(spark, str(root), templates=str(templates))
    assert {r.template: r.score for r in got["template_scores"].collect()} == {"one": 4, "two": 0}
    assert got["detection"].first().asDict() == {"chosen": "one", "origin": "template", "reason": None}
    classes = {r.name: r.layer for r in got["classes"].collect()}
    assert classes["Home"] == "screens" and "Shown" in classes and "Hidden" not in classes
    kinds = [(r.kind, r.dir, r.declarations, r.dominant_foreign, r.language, r.files) for r in got["advisories"].collect()]
    assert kinds == [("vendored-dir", "big", 55, "org.other", None, None), ("unsupported-dominant-language", None, None, None, "shell", 60)]
    (root / ".archloom" / "architecture.yml").write_text("layers:\n  - id: all\n    path_segments: [ui, big]\n")
    again = analyze(spark, str(root), templates=str(templates))
    assert again["detection"].first().origin == "architecture.yml" and {r.name: r.layer for r in again["classes"].collect()}["Home"] == "all"
