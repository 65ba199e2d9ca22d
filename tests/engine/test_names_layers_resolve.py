from pyspark.sql import functions as F

from archloom.functions import text
from archloom.operators import advisories, labels, layers, resolve


def shown(spark, rows):
    """rows: (name, namespace, path, signature); labels in the order of the rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key int, name string, namespace string, path string, signature string")
    return [r.display_name for r in labels.display_names(df).orderBy("key").collect()]


def test_display_names(spark):
    one = lambda name, ns, sig="", path="": (name, ns, path, sig)
    assert shown(spark, [one("parse", "app.kotlin"), one("parse", "app.java"), one("parse", "app.python")]) == ["kotlin", "java", "python"]
    assert shown(spark, [one("run", "a.server"), one("run", "a.engine")]) == ["server:run", "engine:run"]
    assert shown(spark, [one("Gson", "com.g"), one("Other", "com.g")]) == [None, None]
    assert shown(spark, [("go", None, "src/a/x.py", ""), ("go", None, "src/b/x.py", "")]) == ["a:go", "b:go"]
    # one module owning two generic names falls back to its name with a label
    rows = [one("parse", "m.a"), one("parse", "m.b"), one("parse", "m.c"), one("load", "m.a"), one("load", "m.b"), one("load", "m.d")]
    assert shown(spark, rows) == ["a:parse", "b:parse", "c", "a:load", "b:load", "d"]
    # overloads of one name: return type, else parameters, else the whole signature
    assert shown(spark, [one("pub", "m.S", "func pub() -> Pub<Data>"), one("pub", "m.S", "func pub() -> Pub<String>")]) == ["pub → Pub<Data>", "pub → Pub<String>"]
    assert shown(spark, [one("f", "m", "fun f(a: Int = g(1, 2), b: B)"), one("f", "m", "fun f(a: Int)")]) == ["f(a: Int, b: B)", "f(a: Int)"]
    assert shown(spark, [one("f", "m", "val f"), one("f", "m", "var f")]) == ["m.f val f", "m.f var f"]
    assert shown(spark, [one("f", "m", "fun f()"), one("f", "m", "fun f()")]) == ["m.f fun f()"] * 2
    # long contexts shrink to the shortest tail that separates the group
    assert shown(spark, [one("x", "a.b.c.d"), one("x", "e.f.g.h")]) == ["d:x", "h:x"]
    assert shown(spark, [one("x", "a.b.c.k"), one("x", "e.f.g.k"), one("x", "e.f.h.k")]) == ["c/k:x", "g/k:x", "h/k:x"]


def test_signatures():
    split = text.split_signature
    assert split("public func map<R>(_ t: (E) -> R) async throws -> Obs<R> where R: X {", "map") == ("_ t: (E) -> R", "Obs<R>")
    assert split("def run(self, n=[1, 2], *, k: int = 3) -> str:", "run") == ("self, n, *, k: int", "str")
    assert split("fun remap(x)", "map") is None and split("val map", "map") is None and split("", "x") is None and split("f(", "f") is None


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert [one(text.short_name(lit(s))) for s in ("a.b.C<T>", "x::y(z)", "p/q", "plain", "", "a.")] == ["C", "y", "q", "plain", None, None]
    assert one(text.bilingual(lit(None).cast("string"), lit(""), lit("中文 · text"), "en")) == "text" and one(text.bilingual(lit("甲"), lit(None).cast("string"), lit(None).cast("string"), "en")) == "甲"
    assert one(text.bilingual(lit(None).cast("string"), lit(None).cast("string"), lit("one · two"), "zh")) == "one · two"
    assert one(text.display_units(lit("ab漢"))) == 4 and one(text.package_root(lit("a.b.c"))) == "a.b" and one(text.package_root(lit(None).cast("string"))) == ""
    assert [one(text.porcelain_path(lit(s))) for s in ("R  a -> b.py", ' M "c d.py"', "   ")] == ["b.py", "c d.py", None]
    assert one(text.repository_name(lit("https://h.example/o/r.git/"))) == "o__r"
    assert one(text.without_comments(lit('{"u": "http://x", // c\n "a": [1, /* b */ 2,],}'))).replace(" ", "").replace("\n", "") == '{"u":"http://x","a":[1,2]}'
    assert one(text.has_excluded_tag(F.array(lit("Test-x")))) and not one(text.has_excluded_tag(F.array(lit("latest"))))
    assert one(text.module_token(lit(None).cast("string"), lit("a/cost_tracker.py"))) == "cost_tracker"


def test_layers(spark):
    seg = spark.createDataFrame([("ui", 0, "presentation"), ("domain", 1, "domain"), ("data", 2, "data"), ("late", 3, "data")], "layer string, layer_pos int, segment string")
    suf = spark.createDataFrame([("data", 2, "Repository"), ("late", 3, "ory")], "layer string, layer_pos int, suffix string")
    d = spark.createDataFrame([("1", "Repo", "app/domain/order/data/Repo.kt", None), ("2", "UserRepository", "x/y.kt", None), ("3", "Z", "x/y.kt", "a.Domain.b"), ("4", "Z", "x/y.kt", None), ("5", "Z", "data/y.kt", "q::presentation")], "id string, name string, path string, namespace string")
    assert {r.id: r.layer for r in layers.assign_layers(d, seg, suf).collect()} == {"1": "data", "2": "data", "3": "domain", "4": "uncategorized", "5": "ui"}
    fit = lambda counts: layers.template_fit(spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "layer string"), spark.createDataFrame([("a",), ("infra",), ("c",), ("uncategorized",)], "id string")).first()
    assert not fit({"uncategorized": 60, "infra": 30, "a": 2}).fits and fit({"uncategorized": 5, "infra": 3}).fits
    bad = fit({"infra": 20})
    assert not bad.fits and (bad.empty_layers, bad.largest_layer_pct) == (2, 1.0)


def test_groups_and_packing(spark):
    c = spark.createDataFrame([("g", 1, None, "row", ["a", "b"]), ("h", 1, None, "column", ["c", "d"]), ("leaf", 7, 5.0, None, None)], "id string, pos int, order double, layout string, children array<string>")
    got = {r.id: (round(r.order, 4), r.grp) for r in layers.expand_groups(c).collect()}
    assert got == {"a": (1, "g"), "b": (1, "g"), "c": (1.3333, "h"), "d": (1.6667, "h"), "leaf": (5, None)}
    b = spark.createDataFrame([("L", i, f"b{i}", w) for i, w in enumerate((4.0, 4.0, 4.0, 20.0, 1.0))], "layer string, ord int, id string, w double")
    assert {r.id: r.row for r in layers.pack_rows(b, 10, 1).collect()} == {"b0": 0, "b1": 0, "b2": 1, "b3": 2, "b4": 3}


def test_core_view(spark):
    c = spark.createDataFrame([("1", "L", True), ("2", "L", False), ("3", "M", False)], "id string, layer string, core boolean")
    rows, some = layers.core_view(c, spark.createDataFrame([("L",), ("M",)], "id string"))
    assert [r.id for r in rows.collect()] == ["1"] and [r.id for r in some.collect()] == ["L"]


def test_templates_and_advisories(spark):
    sig = spark.createDataFrame([("a", "file", "*.gradle", 2), ("a", "path", "ui", 1), ("b", "dependency", "react", 5), ("clean-architecture", "path", "none", 9)], "template string, kind string, match string, weight int")
    files = spark.createDataFrame([("x/build.gradle",), ("app.gradle",), ("m/ui/f.py",), ("n/ui/g.py",), ("o/ui/g.py",), ("p/ui/g.py",)], "path string")
    scores = layers.template_scores(files, spark.createDataFrame([("uses react",)], "text string"), layers.directory_closure(files), sig)
    assert {r.template: r.score for r in scores.collect()} == {"a": 7, "b": 5, "clean-architecture": 0}
    assert [r.template for r in layers.top_evidence(scores, 2).collect()] == ["a", "b"]
    assert layers.choose_template(scores).first().template == "a" and layers.choose_template(scores.withColumn("score", F.lit(0))).first().template == "clean-architecture"
    d = spark.createDataFrame([("lib", "org.other", i) for i in range(60)] + [("lib", "com.own", 99)] * 5 + [("app", "com.own", i) for i in range(60)], "dir string, root string, ord int")
    own = spark.createDataFrame([("com.own",)], "root string")
    assert [tuple(r) for r in advisories.vendored(d, own).collect()] == [("lib", 65, 60, "org.other")] and advisories.vendored(d, own.limit(0)).count() == 0
    ext = spark.createDataFrame([("php", 30), ("rb", 30), ("py", 9)], "ext string, n long")
    lang = spark.createDataFrame([("php", "PHP"), ("rb", "Ruby")], "ext string, language string")
    assert advisories.dominant_unsupported(ext, lang, spark.createDataFrame([(9,)], "n long")).first().language == "PHP"
    assert advisories.dominant_unsupported(ext, lang, spark.createDataFrame([(30,)], "n long")).count() == 0
    roots = advisories.own_roots(spark.createDataFrame([("namespace = 'com.a.b'\n<groupId>org.x.y</groupId>",)], "text string"), spark.createDataFrame([("z.z.z",)], "namespace string"))
    assert {r.root for r in roots.collect()} == {"com.a", "org.x"}
    assert [r.root for r in advisories.own_roots(spark.createDataFrame([("nothing",)], "text string"), spark.createDataFrame([("z.y.x",)], "namespace string")).collect()] == ["z.y"]


def test_specifiers(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.ts", "lib/widget.ts", "src/deep/up.ts", "root.tsx")], "path string")
    asked = [("src/x.ts", s) for s in ("./a", "./b", "./a.js", "./nope", "@/widget", "@/none", "react", "exact", "./deep/../a")] + [("src/deep/y.ts", "../a")]
    wanted = spark.createDataFrame(asked, "path string, source string")
    aliases = spark.createDataFrame([("@/*", "missing/*", 0, 0), ("@/*", "lib/*", 0, 1), ("exact", "src/a.ts", 1, 0)], "pattern string, target string, pattern_pos int, target_pos int")
    got = {r.source: (r.file, r.via) for r in resolve.resolve_specifiers(wanted, files, aliases).collect()}
    assert got == {
        "./a": ("src/a.ts", "relative"), "./b": ("src/b/index.ts", "relative"), "./a.js": ("src/a.ts", "relative"), "./nope": (None, "unresolved"), "@/widget": ("lib/widget.ts", "alias"),
        "@/none": (None, "unresolved"), "react": (None, "external"), "exact": ("src/a.ts", "alias"), "./deep/../a": ("src/a.ts", "relative"), "../a": ("src/a.ts", "relative"),
    }
    assert resolve.resolve_specifiers(spark.createDataFrame([("src/x.ts", "a")], "path string, source string"), files, None, "src").first().via == "baseUrl"


def test_exports_and_references(spark):
    d = spark.createDataFrame([("a.ts", "A", "m.A", "public", 1), ("a.ts", "hid", "m.hid", "private", 2), ("b.ts", "B", "m.B", "public", 1), ("c.ts", "A", "c.A", "public", 1)], "path string, name string, id string, visibility string, line int")
    pair = lambda *x: [{"local": a, "imported": b} for a, b in x]
    rex = spark.createDataFrame([("bar.ts", 0, "a.ts", True, None, []), ("bar.ts", 1, "b.ts", False, None, pair(("Bee", "B"), ("gone", "hid"))), ("x.ts", 0, "y.ts", True, None, []), ("y.ts", 0, "x.ts", True, None, []), ("y.ts", 1, "b.ts", True, None, []), ("c.ts", 0, "a.ts", True, None, []), ("n.ts", 0, "a.ts", True, "ns", [])], "path string, pos int, file string, star boolean, alias string, names array<struct<local:string,imported:string>>")
    maps = resolve.export_maps(d, rex)
    got = {(r.path, r.name): r.id for r in maps.collect()}
    assert got == {("a.ts", "A"): "m.A", ("b.ts", "B"): "m.B", ("bar.ts", "A"): "m.A", ("bar.ts", "Bee"): "m.B", ("c.ts", "A"): "c.A", ("x.ts", "B"): "m.B", ("y.ts", "B"): "m.B"}
    user = spark.createDataFrame([("u.Use", "u.ts", "Use", 1, ["A", "Alias", "near", "ghost", "Nope", "NS", "lib", "Use"]), ("u.near", "u.ts", "near", 2, [])], "id string, path string, name string, line int, refs array<string>")
    imports = spark.createDataFrame([("u.ts", 0, "./bar", pair(("A", "A"), ("Alias", "A"), ("Nope", "Nope"))), ("u.ts", 1, "lib", pair(("lib", "x"), ("NS", "*"))), ("u.ts", 2, "./other", pair(("A", "other")))], "path string, pos int, raw string, bindings array<struct<local:string,imported:string>>")
    scopes = resolve.import_scopes(imports)
    spec = spark.createDataFrame([("u.ts", "./bar", "bar.ts", "relative"), ("u.ts", "lib", None, "external"), ("u.ts", "./other", None, "unresolved")], "path string, source string, file string, via string")
    rows = resolve.resolve_refs(user, scopes, spec, maps)
    assert {(r.raw, r.dst, r.via, r.reason) for r in rows.collect()} == {("A", "m.A", "barrel", None), ("near", "u.near", "same-file", None), ("Nope", None, None, "not_exported"), ("NS", None, None, "external"), ("lib", None, None, "external")}
    assert tuple(resolve.resolution_stats(rows).first()) == (2, 3, 1, 0, 0.4)
    assert resolve.resolution_stats(rows.limit(0)).first().coverage == 1.0
