import random

import numpy as np

from stratalens.llm import spans


def _brute(texts, length):
    seen = {}
    for i, t in texts.items():
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], set()).add(i)
    pairs, cover = set(), {}
    for w, ids in seen.items():
        pairs |= {(a, b) for a in ids for b in ids if a < b}
    for i, t in texts.items():
        m = np.zeros(len(t), bool)
        r = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            ids = seen[t[p : p + length]]
            if len(ids) > 1:
                m[p : p + length] = True
            if min(ids) < i:
                r[p : p + length] = True
        if m.any():
            cover[i] = (int(m.sum()), int(r.sum()))
    return pairs, cover


def _check(spark, texts, length, k, extra=()):
    rows = [(i, t) for i, t in texts.items()] + list(extra)
    d = spark.createDataFrame(rows, "id long, text string").repartition(3)
    s = spans.Shared(d, length, k)
    pairs, cover = _brute({i: t for i, t in texts.items() if t}, length)
    got = [tuple(r) for r in s.pairs().select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    classes = {}
    for r in s.memberships().collect():
        classes.setdefault((r.class_id, r.n_members), set()).add(r.id)
    assert all(len(v) == n for (_, n), v in classes.items())
    assert {(a, b) for v in classes.values() for a in v for b in v if a < b} == pairs
    assert {r.id: (r.n_shared, r.n_repeated) for r in s.coverage().collect()} == cover


def test_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdé\n 中\U0001f600") for _ in range(n))
    blocks = [word(rnd.randrange(20, 90)) for _ in range(12)]
    texts = {i: "".join(rnd.choice([*blocks, word(25)]) for _ in range(rnd.randrange(0, 6))) for i in range(60)}
    texts[60] = texts[3]
    texts[61] = "a" * 200
    texts[62] = "b" + "a" * 90 + "c"
    texts[63] = "ab" * 70
    _check(spark, texts, 30, 10, [(3, texts[3]), (70, None), (71, "")])


def test_hot_header_below_and_above_the_length(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    short, long = word(28), word(40)
    texts = {i: (short if i % 2 else "") + word(40) for i in range(160)}
    texts |= {200 + i: word(5) + long + word(20) for i in range(70)}
    _check(spark, texts, 30, 10)


def test_empty(spark):
    d = spark.createDataFrame([], "id long, text string")
    assert spans.Shared(d).pairs().count() == 0


def test_large_classes_are_split(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 3)
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    one, two = word(40), word(40)
    texts = {i: word(9) + (one if i % 3 else two) + word(9) for i in range(40)} | {50 + i: one + two for i in range(5)}
    _check(spark, texts, 30, 10)


def _brute_runs(texts, length):
    seen, gone = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        at = [0]
        for x in lines:
            at.append(at[-1] + len(x) + 1)
        m = np.zeros(len(texts[i]) + 1, bool)
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x.rstrip() for x in lines[a:b])
                if sum(len(x) + 1 for x in run) >= length:
                    if run in seen:
                        m[at[a] : at[b - 1] + len(run[-1])] = True
                    seen.add(run)
                    break
        gone[i] = m[:-1]
    return gone


def test_line_runs_against_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    line = lambda: "".join(rnd.choice("abc é\U0001f600") for _ in range(rnd.randrange(0, 14)))
    pool = [line() for _ in range(14)]
    texts = {i: "\n".join(rnd.choice(pool) if rnd.random() < 0.9 else line() for _ in range(rnd.randrange(0, 25))) for i in range(50)}
    texts[51] = texts[4] + "\n"
    rows = [(i, t, "p", None) for i, t in texts.items()] + [(4, texts[4], "p", None), (60, None, "p", None)]
    d = spark.createDataFrame(rows, "id long, text string, path string, h string")
    want = _brute_runs(texts, 30)
    got = {}
    for r in spans.repeated(d, 30).collect():
        m = got.setdefault(r.id, np.zeros(len(texts[r.id]), bool))
        assert not m[r.start : r.end].any()
        m[r.start : r.end] = True
    for i, m in want.items():
        # the line end between two removed runs is of no record's text
        have = got.get(i, np.zeros(len(m), bool))
        assert all(texts[i][k] in "\n " for k in np.flatnonzero(m != have)), i
    d.selectExpr("id as file_id", "text as content").write.parquet(str(tmp_path / "files.parquet"))
    whole = {i: t for i, t in texts.items()}
    monkey, spans.LENGTH = spans.LENGTH, 30
    try:
        for r in spans.p6_kept(spark, str(tmp_path)).collect():
            assert r.text == whole[r.file_id][r.start_char : r.end_char]
    finally:
        spans.LENGTH = monkey


def test_one_block_in_five_thousand_files(spark):
    block = "\n".join(f"line {i} of a licence that everybody carries along" for i in range(10))
    d = spark.range(5000).selectExpr("id", f"concat('own text ', id, '\\n', '{block}', '\\n', 'end ', id) as text".replace("\n", "\\n"))
    gone = spans.repeated(d).selectExpr("count(distinct id)", "count(*)").first()
    assert tuple(gone) == (4999, 4999)
    s = spans.Shared(d)
    assert (5000, 5000) in {tuple(r) for r in s.memberships().groupBy("n_members").count().collect()}  # others differ in what stands around the block
