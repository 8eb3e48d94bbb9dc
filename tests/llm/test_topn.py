import random

from stratalens.llm import topn


def test_loser_tree_against_sorting():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((rnd.randrange(4), rnd.randrange(9), str(rnd.randrange(30))) for _ in range(rnd.randrange(40))) for _ in range(k)]
        want = {}
        for row in sorted({r for run in runs for r in run}):
            want.setdefault(row[0], []).append(row)
        got = {}
        for rank, row in topn.merge_top(runs, 3):
            got.setdefault(row[0], []).append(row)
            assert rank == len(got[row[0]])
        assert got == {g: rows[:3] for g, rows in want.items()}


def test_hot_group_ties_nulls_and_repeats(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randrange(50)}", rnd.choice([0.5, 0.1, 0.9, None, float("nan"), -0.0, 0.0]), f"k{rnd.randrange(400)}é") for _ in range(4000)]
    rows += [(None, 1.0, "a"), ("g1", 1.0, None)] + rows[:200]
    d = spark.createDataFrame([(g, s, k, 7) for g, s, k in rows], "g string, s double, k string, run int").repartition(7)
    want = set()
    groups = {}
    for g, s, k in rows:
        if g and k and s is not None and s == s:
            groups.setdefault(g, set()).add((-s + 0.0, k))
    for g, v in groups.items():
        want |= {(g, i + 1, k) for i, (_, k) in enumerate(sorted(v)[:5])}
    got = [tuple(r) for r in topn.top_n(d, ["g"], "s", "k").select("g", "rank_no", "k").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert topn.top_n(d.limit(0), ["g"], "s", "k").count() == 0
