import random

import pytest
from pyspark.sql import functions as F

from archloom.config import EngineConfig
from archloom.operators import flows, graph

DECL = "id string, name string, namespace string, path string, kind string, visibility string, supertypes array<string>, refs array<string>"


def decls(spark, *rows):
    """(id, path, refs[, supertypes[, visibility]])"""
    full = []
    for r in rows:
        id_, path, refs, supers, vis = (*r, *([], "public")[len(r) - 3 :])
        ns, _, name = id_.rpartition(".")
        full.append((id_, name, ns or None, path, "class", vis, supers, refs))
    return spark.createDataFrame(full, DECL)


def edges_of(df):
    return {(r.src, r.dst, r.kind) for r in df.collect()}


def test_minimal_graph_and_degrees(spark):
    d = decls(spark, ("m.A", "m.py", ["B"]), ("m.B", "m.py", []))
    e = graph.resolve_edges(d)
    assert edges_of(e) == {("m.A", "m.B", "uses")}
    got = {r.id: (r.in_degree, r.out_degree, r.importance) for r in graph.importance(graph.degrees(d, e).join(d.select("id", "visibility"), "id")).collect()}
    assert got == {"m.A": (0, 1, 0.2), "m.B": (1, 0, 0.7)}


def test_false_edge_guard(spark):
    """Another file's declaration needs its module mentioned, unless the match is exact, in the same file, or extends."""
    d = decls(spark, ("caller.run", "caller.py", ["get"]), ("cost.get", "cost.py", []), ("caller.own", "caller.py", ["near"]), ("caller.near", "caller.py", []), ("caller.ex", "caller.py", ["cost.get"]), ("caller.Sub", "caller.py", [], ["Base<T>"]), ("lib.Base", "lib.py", []))
    silent = spark.createDataFrame([("caller.py", "get"), ("caller.py", "other")], "path string, token string")
    always = {("caller.own", "caller.near", "uses"), ("caller.ex", "cost.get", "uses"), ("caller.Sub", "lib.Base", "extends")}
    assert edges_of(graph.resolve_edges(d, silent)) == always
    assert edges_of(graph.resolve_edges(d, silent.union(spark.createDataFrame([("caller.py", "cost")], "path string, token string")))) == always | {("caller.run", "cost.get", "uses")}
    assert edges_of(graph.resolve_edges(d)) == always | {("caller.run", "cost.get", "uses")}


def test_ambiguous_names_give_no_edge(spark):
    d = decls(spark, ("a.x", "a.py", ["go", "only"]), ("b.go", "b.py", []), ("c.go", "c.py", []), ("d.only", "d.py", []), ("a.self", "a.py", ["self"]))
    assert edges_of(graph.resolve_edges(d)) == {("a.x", "d.only", "uses")}


def test_common_names_are_not_paired_with_all_that_bear_them(spark, monkeypatch):
    """200 users of one name that 200 declarations bear: neighbours of a namespace differ, one file has a lone one."""
    d = decls(spark, *[(f"u{k}.x", f"u{k}.py", ["go"]) for k in range(200)], *[(f"t{k}.go", f"t{k}.py", []) for k in range(200)], ("own.x", "t7.py", ["go"]), ("t9.y", "else.py", ["go"]), ("t9.z", "else.py", [], ["go"]))
    want = {("own.x", "t7.go", "uses"), ("t9.y", "t9.go", "uses"), ("t9.z", "t9.go", "extends")}
    made = []
    monkeypatch.setattr(graph, "saved", lambda df, f=graph.saved: (out := f(df), made.append(out.count()))[0])
    found = graph.resolve_edges(d)
    assert edges_of(found) == want and 0 < max(made) <= 403  # no pairs, and what is saved grows with the rows
    monkeypatch.setattr(graph, "FEW", 0)
    assert edges_of(graph.resolve_edges(d)) == want
    silent = spark.createDataFrame([("else.py", "other")], "path string, token string")
    assert edges_of(graph.resolve_edges(d, silent)) == want - {("t9.y", "t9.go", "uses")}
    apart = [("i", "x", "n1", "f.py", ["go"]), ("i", "x", "n2", "f.py", []), ("a", "go", "n1", "a.py", []), ("b", "go", "n2", "b.py", []), ("c", "x", None, None, ["go"]), ("e", "go", None, "e.py", [])]
    rows = spark.createDataFrame([(i, n, ns, p, "class", "public", [], r) for i, n, ns, p, r in apart], DECL)
    assert edges_of(graph.resolve_edges(rows)) == {("c", "e", "uses")}  # rows of one declaration speak for it together


def test_common_names_aren_t_joined_row_by_row(spark):
    """300 users of a name that 300 declarations of one file bear: no join makes 90,000 rows."""
    d = decls(spark, *[(f"u.x{k}", "u.py", ["go"]) for k in range(300)], *[(f"t{k}.go", "t.py", []) for k in range(300)], ("t9.own", "v.py", ["go"]))
    found = graph.resolve_edges(d)
    assert edges_of(found) == {("t9.own", "t9.go", "uses")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "'short" not in plan and not any("short" in x for x in plan.splitlines() if "Join" in x)  # names meet before, in reduced tables


def test_what_is_saved_grows_with_places_not_with_declarations(spark, monkeypatch):
    """300 users in one file are one place; rows of one declaration still speak for it together."""
    d = decls(spark, *[(f"u.x{k}", "u.py", ["go"], ["t.go"]) for k in range(300)], ("t.go", "t.py", []))
    made = []
    monkeypatch.setattr(graph, "saved", lambda df, f=graph.saved: (out := f(df), made.append(out.count()))[0])
    assert edges_of(graph.resolve_edges(d)) == {(f"u.x{k}", "t.go", kind) for k in range(300) for kind in ("uses", "extends")}
    assert max(made) <= 2
    apart = [("i", "x", "n1", "f.py", ["go"]), ("i", "x", "n2", "f.py", []), ("a", "go", "n1", "a.py", []), ("b", "go", "n2", "b.py", []), ("c", "x", None, None, ["go"]), ("e", "go", None, "e.py", [])]
    rows = spark.createDataFrame([(i, n, ns, p, "class", "public", [], r) for i, n, ns, p, r in apart], DECL)
    assert edges_of(graph.resolve_edges(rows)) == {("c", "e", "uses")}


def test_private_penalty_core_and_hubs(spark):
    rows = spark.createDataFrame([(f"m.a{i}", i, 0, v) for i, v in enumerate(["public", "private"] * 20)], "id string, in_degree long, out_degree long, visibility string")
    got = {r.id: r.importance for r in graph.importance(rows, digits=None).collect()}
    assert got["m.a39"] == pytest.approx(0.3 * 0.7) and got["m.a38"] == pytest.approx(0.7 * 38 / 39)
    assert {r.id for r in graph.hubs(rows, 0.1).collect()} == {"m.a39", "m.a38", "m.a37"}
    ties = spark.createDataFrame([(f"n{i:02d}", 5 if i else 9, 0) for i in range(40)], "id string, in_degree long, out_degree long")
    assert {r.id for r in graph.hubs(ties, 0.1).collect()} == {"n00", "n01", "n02", "n03"}
    assert graph.hubs(ties.limit(0)).count() == 0
    layer = spark.createDataFrame([("L", f"m.{n}", x) for n, x in (("ddd", 0.5), ("aaa", 0.5), ("ccc", 0.5), ("bbb", 0.5))], "layer string, id string, importance double")
    core = lambda df, **k: {r.id for r in graph.core(df, EngineConfig(**k)).where("core").collect()}
    assert core(layer, core_percentile=0.25, core_min=1) == {"m.aaa"}
    floor = spark.createDataFrame([("L", f"m.{i}", x) for i, x in enumerate((0.9, 0.8, 0.7, 0.6, 0.5, 0.0))], "layer string, id string, importance double")
    assert core(floor, core_percentile=0.1, core_min=4) == {"m.0", "m.1", "m.2", "m.3"}
    assert core(floor, core_percentile=0.1, core_min=6) == {f"m.{i}" for i in range(5)}


def trace(spark, seeds, nodes, uses, hubs=(), refs=(), index=(), **config):
    names = sorted({*nodes, *(x for e in uses for x in e), *seeds, *(i for _, i in index)})
    frame = spark.createDataFrame([(n, (nodes if isinstance(nodes, dict) else {}).get(n, "L")) for n in names], "id string, layer string")
    e = spark.createDataFrame([(a, b, "uses") for a, b in uses], "src string, dst string, kind string")
    h = spark.createDataFrame([(x,) for x in hubs], "id string")
    s = spark.createDataFrame([(x,) for x in seeds], "id string")
    sizes = {k: sum(a == k for a, _ in index) for k, _ in index}
    ranks: dict = {}
    rows = [(k, i, sizes[k], ranks.setdefault(k, []).append(i) or len(ranks[k])) for k, i in index]
    idx = spark.createDataFrame(rows, "key string, impl string, impls long, rank int")
    r = spark.createDataFrame(list(refs), "id string, refs array<string>")
    return flows.trace_flows(s, frame, e, h, idx, r, EngineConfig(**config))


def orders(df):
    return flows.frames(df)


def omitted(df):
    return sorted((r.flow, r.node, r.via, r.omitted) for r in df.where("omitted > 0").collect())


def plain_trace(seed, adjacency, hubs, layer, refs, index, depth_max, budget, fanout):
    order, depth, parent, left, q = [seed], {seed: 0}, {}, [], [seed]
    for u in q:
        if len(order) >= budget:
            break
        if (u != seed and u in hubs and layer[u] != layer[seed]) or depth[u] >= depth_max:
            continue
        for v in sorted(adjacency.get(u, [])):
            if len(order) < budget and v not in depth:
                depth[v], parent[v] = depth[u] + 1, (u, "uses")
                order.append(v)
                q.append(v)
        for k in dict.fromkeys(refs.get(u, [])):
            if k in index:
                fresh = [i for i in index[k] if i not in depth]
                for v in fresh[:fanout]:
                    if len(order) >= budget:
                        break
                    depth[v], parent[v] = depth[u] + 1, (u, "dispatch")
                    order.append(v)
                    q.append(v)
                if len(fresh) > fanout:
                    left.append((u, k, len(fresh) - fanout))
    return order, parent, left


def test_traces_equal_a_plain_search(spark):
    r = random.Random(12)
    names = [f"n{i:02d}" for i in range(40)]
    uses = {(r.choice(names), r.choice(names)) for _ in range(70)}
    uses = {(a, b) for a, b in uses if a != b}
    index = {"I": r.sample(names, 12), "J": r.sample(names, 3)}
    refs = {n: r.choices(["I", "J", "zzz"], k=r.randint(0, 2)) for n in names}
    hubs, layer = set(r.sample(names, 5)), {n: r.choice("XY") for n in names}
    seeds = r.sample(names, 8)
    adjacency: dict = {}
    for a, b in uses:
        adjacency.setdefault(a, []).append(b)
    for budget, depth in ((60, 8), (7, 3)):
        got = trace(spark, seeds, layer, sorted(uses), hubs, refs.items(), [(k, i) for k, v in index.items() for i in v], max_nodes=budget, max_depth=depth, max_fanout=4)
        rows, want_left, want_order, want_edges = got.collect(), [], {}, set()
        for s in seeds:
            order, parent, left = plain_trace(s, adjacency, hubs, layer, refs, index, depth, budget, 4)
            want_order[f"flow:{s}"] = order
            want_edges |= {(f"flow:{s}", p, v, k) for v, (p, k) in parent.items()}
            want_left += [(f"flow:{s}", u, k, n) for u, k, n in left]
        assert orders(got) == want_order
        assert {(x.flow, x.parent, x.node, x.kind) for x in rows if x.pos} == want_edges
        assert sorted((x.flow, x.node, x.via, x.omitted) for x in rows if x.omitted) == sorted(want_left)


def test_placed_implementors_beyond_the_joined_ranks_are_not_omitted(spark):
    """Keys of more implementors than the cut (2 * 60 + 8), some of the last of which are placed before the key's turn."""
    impls = [f"i{k:03d}" for k in range(150)]
    index = {"I": impls, "J": [*impls[100:], *impls[:100]]}
    refs = {"S": ["I"], "a": ["J", "I"], "i140": ["I"], "i149": ["J"]}
    uses = {("S", "i140"), ("S", "i149"), ("S", "a"), ("a", "i145"), ("a", "i090"), ("i140", "i148"), ("i149", "i139"), ("i130", "a"), ("i130", "i135")}
    seeds, adjacency = ["S", "i140", "i130"], {}
    for a, b in uses:
        adjacency.setdefault(a, []).append(b)
    pairs = [(k, i) for k, v in index.items() for i in v]
    got = trace(spark, seeds, [], sorted(uses), refs=refs.items(), index=pairs)
    layer = dict.fromkeys([*impls, "S", "a"], "L")
    want_order, want_left = {}, []
    for s in seeds:
        order, _, left = plain_trace(s, adjacency, set(), layer, refs, index, 8, 60, 8)
        want_order[f"flow:{s}"] = order
        want_left += [(f"flow:{s}", u, k, n) for u, k, n in left]
    assert orders(got) == want_order
    assert omitted(got) == sorted(want_left) and ("flow:S", "S", "I", 150 - 2 - 8) in want_left


def test_symbols_meet_implementors_only_for_the_frontier(spark, monkeypatch):
    """500 declarations say a key of 60 implementors, two of them are traced: no table of 30,000 rows is written."""
    impls, says = [f"i{k:02d}" for k in range(60)], [f"n{k:03d}" for k in range(500)]
    index = spark.createDataFrame([("I", x, 60, k + 1) for k, x in enumerate(impls)], "key string, impl string, impls long, rank int")
    nodes = spark.createDataFrame([(x, "L") for x in [*impls, *says]], "id string, layer string")
    edges = spark.createDataFrame([("n000", "n002", "uses"), ("n001", "i05", "uses")], "src string, dst string, kind string")
    refs = spark.createDataFrame([(x, ["I"]) for x in says], "id string, refs array<string>")
    seeds, hubs = spark.createDataFrame([("n000",), ("n001",)], "id string"), spark.createDataFrame([], "id string")
    written = []
    monkeypatch.setattr(flows, "saved", lambda df, f=flows.saved: (out := f(df), written.append(out.count()))[0])
    want = {"flow:n000": ["n000", "n002", *impls[:16]], "flow:n001": ["n001", "i05", *[i for i in impls if i != "i05"][:8]]}
    assert orders(flows.trace_flows(seeds, nodes, edges, hubs, index, refs)) == want
    assert max(written) <= 600
    assert orders(flows.trace_flows(seeds, nodes, edges, hubs, index, refs, few=0)) == want


def test_traces_of_small_graphs(spark):
    assert orders(trace(spark, ["U"], [], [("U", "A"), ("A", "U")])) == {"flow:U": ["U", "A"]}
    d = trace(spark, ["U"], [], [], refs=[("U", ["pkg.I<T>"])], index=[("I", "A"), ("I", "B"), ("I", "C")], max_fanout=2)
    assert orders(d) == {"flow:U": ["U", "A", "B"]} and omitted(d) == [("flow:U", "U", "I", 1)]
    assert [len(v) for v in orders(trace(spark, ["s"], [], [("s", x) for x in "abcd"], max_nodes=2)).values()] == [2]
    got = orders(trace(spark, ["S"], {"S": "X", "H": "X", "deep": "X", "K": "Y", "z": "Y"}, [("S", "H"), ("S", "K"), ("H", "deep"), ("K", "z")], hubs=["H", "K"]))
    assert set(got["flow:S"]) == {"S", "H", "K", "deep"}


def test_seeds_and_reach(spark):
    rows = [("m.main", "main", "A", "public", 1, 0.1), ("m.o1", "o1", "A", "public", 5, 0.2), ("m.o2", "o2", "A", "public", 4, 0.9), ("m.o3", "o3", "B", "private", 9, 0.9), ("m.o4", "o4", "B", "public", 3, 0.1), ("m.u", "u", "uncategorized", "public", 2, 0.99)]
    d = spark.createDataFrame([(*r, False) for r in rows], "id string, name string, layer string, visibility string, out_degree long, importance double, hub boolean")
    got = {(r.id, r.seed_kind) for r in flows.select_seeds(d, EngineConfig(max_seeds=2)).collect()}
    assert got == {("m.main", "entry-point"), ("m.o1", "public-orchestrator"), ("m.o2", "public-orchestrator"), ("m.o4", "subsystem")}
    e = spark.createDataFrame([("main", "mid"), ("mid", "hub"), ("hub", "deep"), ("mid", "main")], "src string, dst string")
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {(r.id, r.depth) for r in flows.reach(one("main"), e, one("hub"), 8).collect()} == {("main", 0), ("mid", 1), ("hub", 2)}


def test_reach_is_searched_in_buckets(spark, monkeypatch):
    """Equal to the search row by row, and what is written before the result doesn't grow with seeds times reached nodes."""
    r = random.Random(5)
    edges = {(f"a{i:03d}", f"b{r.randrange(10)}") for i in range(200)} | {(f"b{i}", f"d{k:02d}") for i in range(10) for k in range(60)} | {("d01", "a007"), ("d02", "z"), ("z", "a000"), ("a003", "d05")}
    e = spark.createDataFrame(sorted(edges) + [("a000", "b1")], "src string, dst string")
    seeds = spark.createDataFrame([(f"a{i:03d}",) for i in range(200)] + [("a000",), ("lone",), ("d02",)], "id string")
    hubs = spark.createDataFrame([("d02",), ("b3",), ("a003",)], "id string")
    written = []
    monkeypatch.setattr(flows, "saved", lambda df, f=flows.saved: (out := f(df), written.append(out.count()))[0])
    got = sorted(map(tuple, flows.reach(seeds, e, hubs, 8, together=101).collect()))
    assert len(got) > 8000 and 0 < max(written) < 1500
    assert got == sorted(map(tuple, flows.reach(seeds, e, hubs, 8, held=1).collect()))


def test_dispatch_flows_and_containment(spark):
    rows = [("p.Runner", ["I"], [], 9, 0.5), ("p.Other", ["I"], [], 2, 0.9), ("p.A", [], ["x.I<T>"], 1, 0.8), ("p.B", ["I"], ["I"], 99, 0.7), ("p.H", [], [], 0, 0.9), ("p.C", [], [], 0, 0.2)]
    d = spark.createDataFrame(rows, "id string, refs array<string>, supertypes array<string>, out_degree long, importance double")
    index = graph.dispatch_index(d)
    assert [(r.impl, r.rank) for r in index.orderBy("rank").collect()] == [("p.A", 1), ("p.B", 2)]
    e = spark.createDataFrame([("p.A", "p.H", "uses"), ("p.A", "p.C", "uses"), ("p.B", "p.Runner", "uses")], "src string, dst string, kind string")
    hub = spark.createDataFrame([("p.H",)], "id string")
    got = {(r.key, r.src, r.dst, r.kind) for r in flows.dispatch_flows(d, index, e, hub).collect()}
    assert got == {("I", "p.Runner", "p.A", "dispatch"), ("I", "p.Runner", "p.B", "dispatch"), ("I", "p.A", "p.C", "uses")}
    sets = {"a": "XYZ", "b": "XY", "c": "MN", "d": "MN", "e": "XQ"}
    f = spark.createDataFrame([(k, i, n) for i, (k, ns) in enumerate(sets.items()) for n in ns], "flow string, ord int, node string")
    assert {r.flow for r in flows.suppress_contained(f).collect()} == {"a", "c", "e"}


def test_neighbors_and_mentions(spark):
    e = spark.createDataFrame([("a", "b", "uses"), ("c", "a", "extends")], "src string, dst string, kind string")
    assert {tuple(r) for r in graph.neighbors(e, "a").collect()} == {("b", "out", "uses"), ("c", "in", "extends")}
    files = spark.createDataFrame([("x.py", "get_x = getter(get)")], "path string, content string")
    assert {r.token for r in graph.mentions_of(files).select(F.col("token")).collect()} == {"get_x", "getter", "get"}
