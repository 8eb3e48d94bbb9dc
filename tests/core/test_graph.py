import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import graph as G
from stratalens.operators import resolve as R


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_pagerank_diamond(spark):
    r = {x.id: x["rank"] for x in G.pagerank(nodes(spark, "abcd"), edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "a")])).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and max(r, key=r.get) == "d"
    # against a dense computation
    import numpy as np

    ids, links = "abcd", {"a": "bc", "b": "d", "c": "d", "d": ""}
    x = np.full(4, 0.25)
    for _ in range(200):
        y = np.full(4, 0.15 / 4)
        for i, s in enumerate(ids):
            for t in links[s] or ids:
                y[ids.index(t)] += 0.85 * x[i] / len(links[s] or ids)
        x = y
    assert all(abs(r[i] - x[k]) < 1e-5 for k, i in enumerate(ids))


def test_communities_of_two_triangles_with_a_bridge(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")]
    m = {r.id: r.community_id for r in G.communities(nodes(spark, "abcdefz"), edges(spark, e), rounds=6, levels=2).collect()}
    assert m["a"] == m["b"] == m["c"] != m["d"] == m["e"] == m["f"] and m["z"] == 3


def test_communities_run_until_no_node_gains(spark, monkeypatch):
    from stratalens.plans import graphs

    ring = [(f"{k:02d}{a}", f"{k:02d}{b}") for k in range(12) for a, b in ("ab", "bc", "cd", "da", "ac", "bd")] + [(f"{k:02d}a", f"{(k + 1) % 12:02d}c") for k in range(12)]
    ids = sorted({x for e in ring for x in e})
    monkeypatch.setattr(graphs, "view", lambda s, d, name: nodes(spark, ids) if name == "g_nodes" else edges(spark, ring))
    m = {r.id: r.community_id for r in graphs.QUERIES["gr6_communities"](spark, "").collect()}
    # no single move raises modularity
    deg = {i: sum(i in e for e in ring) for i in ids}
    m2 = sum(deg.values())
    tot = {c: sum(deg[i] for i in ids if m[i] == c) for c in set(m.values())}
    for i in ids:
        near = [m[b if a == i else a] for a, b in ring if i in (a, b)]
        gain = {c: near.count(c) - deg[i] * (tot[c] - (deg[i] if c == m[i] else 0)) / m2 for c in {*near, m[i]}}
        assert gain[m[i]] >= max(gain.values()) - 1e-6
    assert all(len({m[f"{k:02d}{x}"] for x in "abcd"}) == 1 for k in range(12))


def test_betweenness_and_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("d", "d")])
    b = {r.id: r.betweenness for r in G.betweenness(e).collect()}
    assert b == {"b": 1.0, "x": 1.0, "c": 3.0}
    assert G.shortest_path(e, "a", "d") == ["a", "b", "c", "d"] and G.shortest_path(e, "a", "a") == ["a"] and G.shortest_path(e, "d", "a") == []


def test_dead_code(spark):
    n = spark.createDataFrame([("main", "main.go", True, False), ("lib", "lib.go", False, False), ("orphan", "orphan.go", False, False), ("t", "a_test.go", False, True)], "id string, path string, is_entry boolean, is_test boolean")
    d = G.dead_files(n, edges(spark, [("main", "lib")])).collect()
    assert [(r.id, r.confidence, r.safe_to_delete) for r in d] == [("orphan", 1.0, True)]
    sy = nodes(spark, ["Used", "Unused", "Helper"])
    ed = spark.createDataFrame([("main", "Helper", "calls"), ("orphan", "Used", "defines"), ("orphan", "Unused", "defines"), ("Unused", "Used", "calls")], "src string, dst string, edge_type string")
    got = {r.id: r.confidence for r in G.dead_symbols(sy, ed, nodes(spark, ["main"])).collect()}
    assert got == {"Used": 0.5, "Unused": 0.8}


def test_inheritance_and_merge(spark):
    h = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "child string, parent string")
    d = {r.child: r.depth for r in G.inheritance_depth(h, most=6).collect()}
    assert d["c"] == 2 and d["b"] == 1
    e = spark.createDataFrame([("a", "b", "imports", 0.5, 1, ["x", "y"]), ("a", "b", "imports", 1.0, 2, ["y", "z"])], "src string, dst string, edge_type string, confidence double, ordinal int, imported_names array<string>")
    r = G.merge_edges(e).first()
    assert r.confidence == 1.0 and r.imported_names == ["x", "y", "z"]


def test_resolvers(spark):
    files = spark.createDataFrame([("r", p) for p in ["src/a.ts", "src/lib/b.ts", "src/lib/index.ts", "pkg/m.py", "pkg/n/__init__.py", "src/main/java/util/Greeter.java", "src/greeter.rs", "src/lib.rs", "svc/x.go", "svc/x_test.go", "Util/One.cs", "Util/Two.cs", "inc/calc.h"]], "repository_id string, path string")
    rows = [("r", "src/a.ts", "typescript", "./lib/b"), ("r", "src/lib/b.ts", "typescript", "../lib"), ("r", "main.py", "python", "pkg.m"), ("r", "main.py", "python", "pkg.n"), ("r", "M.java", "java", "util.Greeter"), ("r", "M.java", "java", "java.util.List"), ("r", "src/lib.rs", "rust", "crate::greeter::Hi")]
    imp = spark.createDataFrame(rows, "repository_id string, path string, language string, raw string")
    got = {(r.src, r.dst) for r in R.resolve(R.candidates(imp), files).collect()}
    assert got == {("src/a.ts", "src/lib/b.ts"), ("src/lib/b.ts", "src/lib/index.ts"), ("main.py", "pkg/m.py"), ("main.py", "pkg/n/__init__.py"), ("M.java", "src/main/java/util/Greeter.java"), ("src/lib.rs", "src/greeter.rs")}
    one = lambda lang, path, raw: spark.createDataFrame([("r", path, lang, raw)], "repository_id string, path string, language string, raw string")
    assert {r.dst for r in R.go_packages(one("go", "main.go", "m.io/p/svc"), files, "m.io/p").collect()} == {"svc/x.go"}
    assert {r.dst for r in R.by_namespace(one("csharp", "P.cs", "App.Util"), files).collect()} == {"Util/One.cs", "Util/Two.cs"}
    assert {r.dst for r in R.by_suffix(one("cpp", "main.cpp", "calc.h"), files, ("",)).collect()} == {"inc/calc.h"}


def test_calls(spark):
    sy = spark.createDataFrame([("f1::a", "f1", "a", 1, 1, 9), ("f1::in", "f1", "in", 2, 3, 5), ("f2::b", "f2", "b", 1, 1, 4), ("f3::b", "f3", "b", 1, 1, 4)], "id string, file_path string, name string, ordinal int, start_line int, end_line int")
    calls = spark.createDataFrame([(1, "f1", 4), (2, "f1", 8), (3, "f9", 1)], "call_id int, file_path string, line int")
    assert {r.call_id: r.caller for r in R.enclosing(calls, sy).collect()} == {1: "f1::in", 2: "f1::a", 3: None}
    c = spark.createDataFrame([(1, "f1", "f1::a", "in", None), (2, "f1", "f1::a", "b", "x"), (3, "f1", "f1::a", "b", None), (4, "f1", "f1::a", "none", None)], "call_id int, file_path string, caller string, target string, receiver string")
    im = spark.createDataFrame([("f1", "f3", 1)], "src string, dst string, ordinal int")
    assert {r.call_id: (r.callee, r.confidence) for r in R.call_edges(c, sy, im).collect()} == {1: ("f1::in", 1.0), 2: ("f3::b", 0.7), 3: ("f2::b", 0.3)}


def test_deep_graphs_are_walked_in_one_task(spark):
    # a chain of 400 links: a job for each would take minutes
    chain = edges(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(400)] + [("n400", "n000"), ("z", "n000")])
    began = time.time()
    got = {r.id: r.depth for r in G.reachable(chain, nodes(spark, ["n000", None])).collect()}
    assert got == {f"n{i:03d}": i for i in range(401)} | {None: 0} and time.time() - began < 60


@pytest.mark.parametrize("most", [0, 3, 6])
def test_rounds_and_one_task_reach_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(G.alone, "WALKED", most)
    e = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11), (11, 3), (1, 3), (20, 1), (21, 22), (22, 21), (2, 2)]
    got = {r.id: r.depth for r in G.reachable(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame([(1,), (40,)], "id int")).collect()}
    assert got == {1: 0, 40: 0, 2: 1, 3: 1} | {i: i - 2 for i in range(4, 12)}


def deep(spark):
    """A chain of 400 links from an entry point, and two files that nothing reaches."""
    ids = [f"n{i:03d}" for i in range(401)] + ["odd", "out"]
    n = spark.createDataFrame([(i, f"src/{i}.go", i == "n000", False) for i in ids], "id string, path string, is_entry boolean, is_test boolean")
    return n, edges(spark, [*zip(ids, ids[1:401]), ("odd", "out"), ("odd", "n000")])


def test_dead_files_of_a_deep_graph(spark):
    began = time.time()
    got = {tuple(r) for r in G.dead_files(*deep(spark)).collect()}
    assert got == {("odd", "src/odd.go", 0, 1.0, True), ("out", "src/out.go", 1, 0.6, False)} and time.time() - began < 60


def test_dead_order_of_a_deep_graph(spark, monkeypatch):
    from stratalens.plans import cards

    n, e = deep(spark)
    monkeypatch.setattr(cards, "view", lambda s, d, name: n if name == "g_nodes" else e)
    began = time.time()
    assert [r.id for r in cards.QUERIES["srt4_dead_order"](spark, "").collect()] == ["odd", "out"] and time.time() - began < 60


def test_dead_order_needs_no_walk_where_enough_is_unlinked(spark, monkeypatch):
    from stratalens.plans import cards

    n, e = deep(spark)
    more = [(f"x{i:03d}", f"src/{i % 7}.go", i == 5, i == 6) for i in range(110)]
    n, e = n.unionAll(spark.createDataFrame(more, n.schema)), e.unionAll(edges(spark, [("x000", "x000"), (None, "x001")]))
    monkeypatch.setattr(cards, "view", lambda s, d, name: n if name == "g_nodes" else e)
    want = [r for r in G.dead_files(n, e).orderBy(F.desc("confidence"), "path", "id").limit(100).collect()]
    types = G.dead_files(n, e).dtypes
    monkeypatch.setattr(G, "reachable", lambda *a: pytest.fail("the graph is walked"))
    got = cards.QUERIES["srt4_dead_order"](spark, "")
    assert got.collect() == want and got.dtypes == types and len(want) == 100 and {r.confidence for r in want} == {1.0}
    assert not {r.id for r in want} & {"x000", "x001", "x005", "x006", "out"}


@pytest.mark.parametrize("limit", [1, 3, 4, 9])
def test_surest_dead_are_the_first_of_all_dead(spark, limit):
    # dup is an entry point in one row only; loop links to itself; c and d are linked from dead files
    n = [(1, "m", True, False), (2, "z", False, False), (3, "b", False, True), (4, "a", False, False), (5, "a", False, False), (6, "dup", True, False), (6, "dup", False, False), (7, "loop", False, False), (8, "c", False, False), (9, "d", False, False), (10, "y", False, False), (None, "null", False, False)]
    n = spark.createDataFrame(n, "id long, path string, is_entry boolean, is_test boolean")
    e = spark.createDataFrame([(1, 10), (7, 7), (2, 8), (3, 9), (2, 8), (8, None)], "src long, dst long")
    order = [F.desc("confidence"), "path", "id"]
    want = [(4, 1.0), (5, 1.0), (None, 1.0), (2, 1.0), (8, 0.6), (9, 0.6), (7, 0.6)]
    some, whole = G.surest_dead(n, e, limit).orderBy(*order).limit(limit).collect(), G.dead_files(n, e).orderBy(*order).limit(limit).collect()
    assert some == whole and [(r.id, r.confidence) for r in some] == want[:limit]


def test_communities_of_a_sparse_graph_end(spark):
    rnd = random.Random(3)
    pairs = sorted({(rnd.randrange(1500), rnd.randrange(1500)) for _ in range(1700)})
    began = time.time()
    df = spark.createDataFrame(pairs, "src long, dst long")
    both = [{r.id: r.community_id for r in G.communities(spark.range(1500), d).collect()} for d in (df, df.repartition(3, "dst"))]
    m = both[0]
    assert both[0] == both[1] and len(m) == 1500 and time.time() - began < 120
    # no move of a node, alone or to a neighbour, and no merge of two communities raises modularity
    links = [(a, b) for a, b in pairs if a != b]
    k = Counter(x for e in links for x in e)
    m2, tot = sum(k.values()), Counter()
    for i, c in m.items():
        tot[c] += k[i]
    near = Counter()
    for a, b in links:
        near[a, m[b]] += 1
        near[b, m[a]] += 1
    gain = lambda i, c: near[i, c] * m2 - k[i] * (tot[c] - (k[i] if c == m[i] else 0))
    assert all(gain(i, c) <= max(0, gain(i, m[i])) for i, c in near) and all(gain(i, m[i]) >= 0 for i in m)
    between = Counter(tuple(sorted((m[a], m[b]))) for a, b in links if m[a] != m[b])
    assert between and all(n * m2 <= tot[a] * tot[b] for (a, b), n in between.items())


@pytest.mark.parametrize("most", [0, 4])
def test_communities_by_rounds_and_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(G.alone, "DIVIDED", most)
    e = [(a, b) for k in range(4) for a in range(5 * k, 5 * k + 5) for b in range(a + 1, 5 * k + 5)] + [(0, 5), (10, 15)]
    m = {r.id: r.community_id for r in G.communities(spark.range(21), spark.createDataFrame(e, "src long, dst long")).collect()}
    # 4 cliques, two by two tied by one link
    assert all(len({m[i] for i in range(5 * k, 5 * k + 5)}) == 1 for k in range(4)) and len(set(m.values())) == 5 and m[20] == 5


def test_loops_and_heavy_links_in_one_task():
    g = G.alone.Graph(4, np.array([0, 1, 2, 2, 1]), np.array([1, 0, 3, 2, 2]), np.array([3, 2, 4, 5, 1]) * 2**30)
    assert g.k == [5 * 2**30, 6 * 2**30, 15 * 2**30, 4 * 2**30] and g.m2 == 30 * 2**30
    c = G.alone.louvain(g)
    assert c[0] == c[1] != c[2] == c[3]
