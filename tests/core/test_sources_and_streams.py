from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import mining as M
from stratalens.sources import reports as S
from stratalens.streaming import watch


def test_lcov_and_cobertura(spark):
    text = "SF:calc\nDA:1,3\nDA:2,0\nDA:3,1\nDA:3,0\nBRF:4\nBRH:2\nend_of_record\nSF:util\nDA:1,1\nDA:2,5\nend_of_record"
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate(text.split("\n"))], "report int, line_no int, line string")
    got = {r.path: (round(r.line_pct, 1), r.branch_pct, r.covered_lines) for r in S.lcov(d).collect()}
    assert got == {"calc": (66.7, 50.0, [1, 3]), "util": (100.0, None, [1, 2])}
    xml = '<coverage><class name="a" filename="calc" branch-rate="0.25"><lines><line number="1" hits="1"/><line number="2" hits="0"/></lines></class></coverage>'
    c = spark.createDataFrame([(xml,)], "text string")
    r = S.cobertura(c).first()
    assert (r.path, r.line_pct, r.branch_pct) == ("calc", 50.0, 25.0) and c.select(S.coverage_format(c.text).alias("f")).first().f == "cobertura"


def test_manifests_and_ignores(spark):
    f = spark.createDataFrame([("package.json", '{"dependencies": {"react": "^18"}, "devDependencies": {"jest": "29"}}'), ("requirements.txt", "requests==2.1\n# no\n"), ("go.mod", "module x\nrequire github.com/google/uuid v1.2.0\n"), ("Cargo.toml", '[package]\nname = "a"\n[dependencies]\nserde = "1.0"\n'), ("vendor/package.json", '{"dependencies": {"no": "1"}}')], "path string, content string")
    got = {(r.ecosystem, r.name, r.is_dev) for r in S.manifests(f).collect()}
    assert got == {("npm", "react", False), ("npm", "jest", True), ("pypi", "requests", False), ("go", "github.com/google/uuid", False), ("cargo", "serde", False)}
    p = spark.createDataFrame([(x,) for x in ["a.log", "keep.log", "build/x", "src/build/y", "doc/a.md", "x/doc/a.md"]], "p string")
    rules = ["# note", "*.log", "!keep.log", "build/", "/doc"]
    assert {r.p for r in p.where(S.ignored(p.p, rules)).collect()} == {"a.log", "build/x", "src/build/y", "doc/a.md"}


def test_walk_flags(spark):
    rows = [("node_modules/a.js", 1, ""), ("a.min.js", 1, ""), ("a.so", 1, ""), ("big.py", 600 * 1024, ""), ("x.zzz", 1, ""), ("a.py", 1, "a\0b"), ("b.go", 1, "// Code generated by x"), ("ok.ts", 1, "x"), ("Dockerfile", 1, "")]
    d = spark.createDataFrame(rows, "path string, size long, content string")
    got = [r.s for r in d.select(T.skip_reason(d.path, d["size"], d.content).alias("s")).collect()]
    assert got == ["directory", "filename", "extension", "size", "language", "binary", "generated", None, None]


def test_security_and_decisions(spark):
    key = "AKIA" + "Q7ZK2MWN4XTR8YBD"
    rows = [(1, "a.py", f'k = "{key}"\nhashlib.md5(x)\nq = "SELECT a FROM b" + c\nos.system("ls")\n# DECISION: keep it simple\n'), (2, "a.md", f"{key}"), (3, "b.py", "# why: lower case only\n")]
    d = spark.createDataFrame(rows, "id int, path string, text string")
    assert {(r.id, r.line_no, r.kind) for r in M.security(d).collect()} == {(1, 1, "aws_access_key"), (1, 2, "weak_hash"), (1, 3, "sql_injection")}
    assert key not in "".join(r.snippet for r in M.security(d).collect())
    assert [(r.id, r.line_no, r.marker, r.title) for r in M.inline_decisions(d).collect()] == [(1, 5, "DECISION", "keep it simple")]
    log = spark.createDataFrame([(1, "# Changelog\n- BREAKING before\n## [2.0.0] - 2024-01-01\n- BREAKING: drop it\n- small\n## v1.0.0\n* incompatible change\n")], "id int, text string")
    assert [(r.version, r.entry) for r in M.changelog(log).orderBy("line_no").collect()] == [("2.0.0", "BREAKING: drop it"), ("v1.0.0", "incompatible change")]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])], "vec_id int, embedding array<float>")
    got = [(r.vec_id, r.cosine) for r in M.nearest(v, [0.9, 0.1, 0.0], 3).collect()]
    assert got[0][0] == 1 and got[0][1] > got[1][1] > 0 and got[2] == (3, 0.0)
    assert M.mock_vector("a", 40) == M.mock_vector("a", 40) and len(M.mock_vector("a", 40)) == 40 and all(-1 <= x < 1 for x in M.mock_vector("b"))


def test_nearest_of_each_query(spark):
    rows = [(i, M.mock_vector(str(i % 50), 8)) for i in range(90)] + [(90, [0.0] * 8), (91, [1.0]), (92, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in M.nearest_each(v, v.where("vec_id % 20 = 0"), 5, rows=30, asked=2).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.cosine))
    floats = {r.vec_id: r.embedding for r in v.collect()}
    assert set(got) == {0, 20, 40, 60, 80}
    for q, near in got.items():
        want = [(r.vec_id, r.cosine) for r in M.nearest(v.where("vec_id <> 92"), floats[q], 5).collect()]
        assert sorted(near, key=lambda x: (-x[1], x[0])) == want
    assert M.nearest_each(v.limit(0), v.limit(0)).count() == 0


def test_nearest_without_its_query_row(spark, monkeypatch):
    from stratalens.plans import texts

    v = spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<float>")
    monkeypatch.setattr(texts, "table", lambda s, d, n: v)
    assert [tuple(r) for r in texts.QUERIES["srt5_nearest"](spark, "").collect()] == [(5, None)]


def test_streams(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [("r", "a", "write", t0), ("r", "b", "write", t0 + timedelta(seconds=1)), ("r", ".git/x", "write", t0 + timedelta(seconds=2)), ("r", "c", "chmod", t0 + timedelta(seconds=2)), ("r", "d", "write", t0 + timedelta(seconds=9)), ("r", "z", "write", t0 + timedelta(hours=1))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "repository_id string, path string, op string, ts timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("repository_id string, path string, op string, ts timestamp").parquet(src)
    q = watch.bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r["first"], r.n) for r in spark.table("bursts").collect())
    assert got == [(t0, 2), (t0 + timedelta(seconds=9), 1)]
    e = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    cache = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, content_hash string")
    assert {r.path: r.status for r in watch.changes(e, cache).collect()} == {"a": "reused", "b": "changed"}
