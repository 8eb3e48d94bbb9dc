from datetime import datetime, timedelta

import pytest

from stratalens.operators import gitstats as G
from stratalens.operators import health as H
from stratalens.operators import insights as I
from stratalens.operators import runs as U

NOW = datetime(2026, 5, 1, 12)


def touches(spark, rows):
    data = [(c, p, a, d, NOW - timedelta(days=ago), who, who.lower() + "|" + who.lower() + "@x", NOW) for c, p, a, d, ago, who in rows]
    return spark.createDataFrame(data, "commit_id long, path string, additions long, deletions long, ts timestamp_ntz, author_name string, author string, now timestamp_ntz")


def test_ownership(spark):
    t = touches(spark, [(1, "foo.go", 1, 0, 1, "Alice"), (2, "foo.go", 1, 0, 2, "Alice"), (3, "foo.go", 1, 0, 3, "Alice"), (4, "foo.go", 1, 0, 100, "Bob")])
    r = G.signals(t).first()
    assert (r.total_commits, r.commits_90d, r.commits_30d, r.owner_share, r.contributors, r.bus_factor) == (4, 3, 3, 0.75, 2, 2)
    assert r.owner.startswith("alice") and r.recent_owner.startswith("alice") and r.age_days >= 100 and r.churn_pct == 1.0


def test_cochange_skips_single_and_large_commits(spark):
    rows = [(1, "foo.go", 1, 0, 1, "A"), (2, "foo.go", 1, 0, 1, "A"), (2, "bar.go", 1, 0, 1, "A")] + [(3, f"f{i}.go", 1, 0, 1, "A") for i in range(201)]
    got = {(r.path, r.partner): r.n for r in G.partners(touches(spark, rows)).collect()}
    assert got == {("foo.go", "bar.go"): 1, ("bar.go", "foo.go"): 1}


def test_churn_over_many_partitions(spark):
    rows = [(i, f"p{i:03d}", i % 7, 0, 1, "A") for i in range(100)]
    got = {r.path: r.churn_pct for r in G.churn(touches(spark, rows)).collect()}
    order = sorted(range(100), key=lambda i: (i % 7, f"p{i:03d}"))
    assert all(abs(got[f"p{i:03d}"] - k / 99) < 1e-12 for k, i in enumerate(order))


def test_empty_tables(spark):
    t = touches(spark, [])
    for f in (G.per_file, G.authors, G.owners, G.bus_factor, G.churn, G.pairs, G.partners, I.git_card):
        assert f(t).count() == 0


@pytest.mark.parametrize(("message", "want"), [("feat(x): y", "feature"), ("Revert \"fix\"", "other"), ("fix!: z", "fix"), ("Bump a", "dependency"), ("", "other"), ("circle", "chore"), ("perf: faster", "refactor"), ("Write README", "docs")])
def test_category(spark, message, want):
    d = spark.createDataFrame([(message,)], "m string")
    assert d.select(G.category(d.m).alias("c")).first().c == want


def test_compare(spark):
    f = lambda m: spark.createDataFrame(list(m.items()), "file string, score double")
    got = {r.file: (r.status, r.delta) for r in H.compare(f({"a": 8.0, "b": 5.0, "gone": 7.0}), f({"a": 6.0, "b": 7.0, "new": 9.0})).collect()}
    assert got == {"a": ("regressed", -2.0), "b": ("improved", 2.0), "gone": ("removed", None), "new": ("new", None)}


BODY = "func a() {\n  x := load(1)\n  y := load(2)\n  z := x + y\n  save(z)\n  log(z)\n  return z\n}\n"


@pytest.mark.parametrize(("texts", "n", "sites"), [([BODY, BODY], 2, 2), (["  " + BODY.replace("\n", "  // note\n"), BODY], 2, 2), ([BODY] * 12, 0, None), (["}\n\n}\n" * 9], 0, None), ([BODY] * 3, 3, 3)])
def test_duplication(spark, texts, n, sites):
    d = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, content string")
    got = H.duplication(d).collect()
    assert len(got) == n and all(r.sites == sites for r in got)


def test_incremental_equals_full(spark):
    def sym(rows):
        return spark.createDataFrame([(f, n, n, "function", None, "f(a, b, c, d, e)", c, 5, 1, e) for f, n, c, e in rows], "file string, id string, name string, kind string, parent_name string, signature string, ccn int, nesting int, start_line int, end_line int")

    old, new = sym([("a", "x", 30, 90), ("b", "y", 3, 5), ("gone", "z", 60, 200)]), sym([("a", "x", 30, 90), ("b", "y", 55, 130), ("c", "w", 12, 61)])
    changed = spark.createDataFrame([("b",), ("c",)], "file string")
    rows = lambda d: sorted(tuple(map(str, r)) for r in d.collect())
    assert rows(H.incremental(H.local_findings(old), new, changed)) == rows(H.local_findings(new))


def test_upsert_versions_and_retention(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = {tuple(r) for r in U.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()}
    assert got == {(1, "a"), (2, "c"), (3, "d")}
    pages = spark.createDataFrame([("p", 1, "x"), ("q", 4, "y")], "path string, version int, content string")
    cur, hist = U.versions(pages, spark.createDataFrame([("p", "z"), ("q", "y"), ("n", "w")], "path string, content string"))
    assert {tuple(r) for r in cur.collect()} == {("p", 2, "z"), ("q", 4, "y"), ("n", 1, "w")} and {tuple(r) for r in hist.collect()} == {("p", 1, "x")}


def test_feature_envy(spark):
    calls = [("m", "Server", "db")] * 5 + [("m", "Server", "fmt")] * 9 + [("m", "Server", "s")] * 3 + [("k", "Server", "db")]
    d = spark.createDataFrame(calls, "method string, own string, receiver string")
    r = H.feature_envy(d, ("fmt",)).collect()
    assert [(x.method, x.receiver, x.n) for x in r] == [("m", "db", 5)]
