from stratalens.operators import build as B
from stratalens.sources import parse as P
from stratalens.sources import settings as S


def test_symbols():
    py = P.symbols_of("class A:\n    def f(self, x):\n        if x:\n            for y in x:\n                pass\n\ndef _g():\n    return 1 if 2 else 3\n", "python")
    assert [(r[0], r[1], r[3], r[4], r[5], r[6], r[7], r[8]) for r in py] == [("A", "class", 1, 5, "public", 3, 2, None), ("f", "method", 2, 5, "public", 3, 2, "A"), ("_g", "function", 7, 8, "protected", 2, 1, None)]
    go = P.symbols_of("package a\n\ntype S struct {\n\tx int\n}\n\nfunc (s *S) Do(a int) {\n\tif a > 1 {\n\t\tfor {\n\t\t}\n\t}\n}\n\nfunc help() {}\n", "go")
    assert [(r[0], r[1], r[3], r[4], r[5], r[6], r[7], r[8]) for r in go] == [("S", "class", 3, 5, "public", 1, 0, None), ("Do", "method", 7, 12, "public", 3, 2, "S"), ("help", "function", 14, 14, "private", 1, 0, None)]
    ja = P.symbols_of("public class A {\n    private int f(int a) {\n        return a > 1 ? 2 : 3;\n    }\n}\n", "java")
    assert [(r[0], r[1], r[5], r[6], r[8]) for r in ja] == [("A", "class", "public", 2, None), ("f", "method", "private", 2, "A")]
    assert P.symbols_of("def f(:\n", "python") == [] and P.symbols_of("x", "json") == []


def test_parse_rows_and_structure(spark):
    f = spark.createDataFrame([("r", "a.py", "python", "class A:\n    def f(self): pass\n"), ("r", "b.py", "python", None), ("r", "c.py", "python", "")], "repository_id string, path string, language string, content string")
    s = P.symbols(f)
    assert {(r.id, r.ordinal) for r in s.collect()} == {("a.py::A", 0), ("a.py::A::f", 1)}
    assert {(r.src, r.dst, r.edge_type) for r in B.structure_edges(s).collect()} == {("a.py", "a.py::A", "defines"), ("a.py", "a.py::A::f", "defines"), ("a.py::A", "a.py::A::f", "has_method")}
    assert P.symbols(f.limit(0)).count() == 0


def test_settings(monkeypatch):
    monkeypatch.setenv("SL_K", "5")
    assert S.resolve({"k": 1, "m": 2}, {"m": 3}, {"m": None}, env_prefix="SL_") == {"k": 5, "m": 3}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert S.retry(flaky, 3, lambda e: isinstance(e, OSError), lambda w: None) == 7
    doc = S.merge_section("# T\n", "body", "x", "1")
    assert S.merge_section(doc, "body", "x", "2") == doc and "other" in S.merge_section(doc, "other", "x", "2") and S.merge_section(doc, "other", "x", "2").startswith("# T")
