from stratalens.llm import mixing


def test_quotas_shares_and_caps(spark):
    docs = [(i, "A" if i % 3 else " b", 10 + i % 50) for i in range(3000)] + [(9000 + i, "few", 20) for i in range(10)] + [(9999, None, 5), (9998, "else", 5), (9997, "a", 0)]
    sized = spark.createDataFrame([(i, s.strip().lower() if s else s, n) for i, s, n in docs], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("B ", 0.5, 4), ("few", 0.2, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    copies, q = mixing.mixture(sized, targets)
    s = {r.source: r for r in mixing.shares(copies, q).collect()}
    total = sum(r.tokens_used for r in s.values())
    have = sum(n for _, x, n in docs if x in ("A", " b", "few"))
    assert abs(total - have) < 300
    assert s["few"].tokens_used == 400 and s["few"].most_copies == 2 and s["none"].tokens_used == 0
    assert s["b"].most_copies <= 4 and s["a"].most_copies == 1
    assert abs(s["b"].actual_share / s["a"].actual_share - 2.5) < 0.03
    rows = [tuple(r) for r in copies.collect()]
    assert len({r[0] for r in rows}) == len(rows)


def test_empty(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    copies, q = mixing.mixture(sized, targets)
    assert copies.count() == 0 and q.count() == 1 and mixing.shares(copies, q).collect()[0].tokens_used == 0


def test_hot_sizes_are_numbered_once(spark):
    sized = spark.range(5000).selectExpr("id as doc_id", "'s' as source", "7L as n_tokens")
    targets = spark.createDataFrame([("s", 1.0, 3)], "source string, target_share double, max_repeats int")
    copies, _ = mixing.mixture(sized, targets)
    assert copies.selectExpr("sum(n_copies)").collect()[0][0] in (4999, 5000, 5001)
