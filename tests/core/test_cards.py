import pytest

from stratalens.operators import cards as C
from stratalens.operators import health as H
from stratalens.operators import mining as M


def test_optional_and_pages(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], None) for i in range(6)], "id long, k string, z string")
    assert {r.id for r in C.optional(d, k="a", z=None).collect()} == {0, 2, 4}
    assert C.optional(d, k=None).count() == 6 and C.optional(d, k="c").count() == 0
    with pytest.raises(Exception):
        C.optional(d, nothing=1).count()
    assert C.clamped(None, None) == (50, 0) and C.clamped(0, -2) == (50, 0) and C.clamped(1000, 3) == (200, 3)
    assert [r.id for r in C.page(d, ["id"], 2, 3).collect()] == [3, 4]


def test_orders(spark):
    d = spark.createDataFrame([(1, "low", "b", 1), (2, "critical", "z", 1), (3, "odd", "a", 1), (4, "HIGH", "a", 2), (5, None, "a", 1)], "finding_id long, severity string, file_path string, line int")
    assert [r.finding_id for r in C.by_severity(d).collect()] == [2, 4, 1, 5, 3] or [r.finding_id for r in C.by_severity(d).collect()][:3] == [2, 4, 1]
    dead = spark.createDataFrame([(1, "b", 0.6), (2, "a", 0.6), (3, "c", 1.0)], "id long, path string, confidence double")
    assert [r.id for r in C.dead_first(dead).collect()] == [3, 2, 1]


def test_lookups(spark):
    n = spark.createDataFrame([("r", "a/x.py"), ("r", "b/x.py"), ("r", "x.py"), ("q", "a/x.py"), ("q", "a/x.py")], "repository_id string, node_id string")
    w = spark.createDataFrame([("r", "x.py"), ("q", "x.py"), ("r", "b/x.py"), ("r", "none")], "repository_id string, wanted string")
    assert {tuple(r) for r in C.prefer_exact(n, w).collect()} == {("r", "x.py", "x.py"), ("q", "x.py", "a/x.py"), ("r", "b/x.py", "b/x.py")}
    s = spark.createDataFrame([(1, "loadRows", "b"), (2, "load_rows", "a"), (3, "LoadRows", "a"), (4, "_", "a")], "symbol_id long, name string, file_path string")
    t = spark.createDataFrame([("load_rows",), ("LOADROWS",), ("x",), ("",)], "token string")
    assert {tuple(r) for r in C.rescue(t, s).collect()} == {("load_rows", 2, "load_rows"), ("LOADROWS", 3, "LoadRows")}


def test_counts_have_fixed_values(spark):
    d = spark.createDataFrame([("failed",), ("failed",), (None,)], "state string")
    got = {(r.value, r.n) for r in C.counts({"state": (d, "state")}, {"state": C.STATES}).collect()}
    assert got == {("failed", 2), ("pending", 0), ("running", 0), ("completed", 0), ("cancelled", 0)}


def test_first_wins_and_json(spark):
    d = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 5, "y"), ("b", 5, "y")], "k string, seq long, v string")
    assert {tuple(r) for r in C.first_wins(d, ["k"], "seq").collect()} == {("a", 1, "x"), ("b", 5, "y")}
    assert {r.json for r in C.as_json(d).collect()} == {'{"k":"a","seq":2}', '{"k":"a","seq":1,"v":"x"}', '{"k":"b","seq":5,"v":"y"}'}
    r = spark.createDataFrame([("s", "f", 1, "t", 9, "late"), ("s", "f", 1, "t", 3, "first")], "source string, file string, line_no int, title string, seq long, text string")
    assert [x.text for x in M.first_records(r).collect()] == ["first"]


def test_runs_and_registry(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "repository_id string, head string")
    heads = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "repository_id string, head string")
    assert {tuple(r) for r in C.plan_runs(stored, heads).collect()} == {("a", "skip"), ("b", "run"), ("c", "run"), ("d", "new")}
    assert {tuple(r) for r in C.plan_runs(stored, heads, True).collect()} == {("a", "run"), ("b", "run"), ("c", "run"), ("d", "new")}
    repos = spark.createDataFrame([("a", True, False), ("b", False, True), ("c", True, True), ("d", True, False)], "id string, tracked boolean, ephemeral boolean")
    gone = spark.createDataFrame([("d",)], "id string")
    assert {r.id for r in C.registry_after(repos, gone).collect()} == {"a", "c"} and {r.id for r in C.registry_after(repos, gone, True).collect()} == {"a", "b", "c"}
    t, seen = C.Tasks(), []
    t.add("one", lambda c: c["n"] > 0, lambda c: seen.append(1))
    t.add("two", lambda c: False, lambda c: seen.append(2))
    t.add("three", lambda c: True, lambda c: 1 / 0)
    t.add("four", lambda c: True, lambda c: seen.append(4))
    assert [x[1].split(":")[0] for x in t.run({"n": 1})] == ["done", "skipped", "failed", "done"] and seen == [1, 4]


def test_shotgun_counts_close_partners_only(spark):
    p = spark.createDataFrame([("a", f"p{i}", 3) for i in range(9)] + [("b", f"p{i}", 2) for i in range(9)], "path string, partner string, n long")
    assert [tuple(r) for r in H.shotgun(p).collect()] == [("a", 9, 1.25)]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "id string, tracked boolean, ephemeral boolean")
    assert C.registry_after(d, d).count() == 0 and C.as_json(d).count() == 0 and C.optional(d, id="x").count() == 0
