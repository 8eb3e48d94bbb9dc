import random

from stratalens.llm import pieces


def _rebuild(rows):
    out = b""
    for r in sorted(rows, key=lambda r: r.piece_no):
        out += r.text.encode()[r.n_overlap :]
    return out.decode()


def _items(spark, texts):
    return spark.createDataFrame([("file", i, t) for i, t in enumerate(texts)], "kind string, id long, text string")


def test_pieces_rebuild_and_stay_under_the_limit(spark):
    rnd = random.Random(5)
    lines = "".join("x" * rnd.randrange(90) + ("\n\n" if rnd.random() < 0.2 else "\r\n") for _ in range(6000))
    texts = ["a" * 8000, "a" * 8001, "é" * 9000, "\U0001f600" * 50000, lines, "\n" * 20000, None, "", "短い\n" * 9000, "b" * 200001]
    big = pieces.oversized(_items(spark, texts))
    for size, halo in ((1 << 16, 512), (4096, 300)):
        parts = pieces.ranges(big, size, halo)
        rows = pieces.emit(parts, pieces.layout(parts, size=size), size).collect()
        by = {}
        for r in rows:
            by.setdefault(r.item_id, []).append(r)
        assert sorted(by) == [i for i, t in enumerate(texts) if t and len(t.encode()) > 8000]
        for i, own in by.items():
            assert _rebuild(own) == texts[i]
            own.sort(key=lambda r: r.piece_no)
            assert [r.piece_no for r in own] == list(range(len(own)))
            for r in own:
                assert len(r.text.encode()) <= 8000 and (r.n_overlap == 0 if r.piece_no == 0 else 200 <= r.n_overlap <= 600)
        ends = [r.text[-1] for r in by[4]]
        assert set(ends) == {"\n"}


def test_repeated_rows_and_empty_table(spark):
    t = _items(spark, ["line\n" * 4000])
    parts = pieces.ranges(pieces.oversized(t.unionAll(t)))
    laid = pieces.layout(parts)
    n = laid.count()
    assert n == laid.distinct().count() and pieces.emit(parts, laid).count() == n
    none = pieces.ranges(pieces.oversized(t.limit(0)))
    assert pieces.layout(none).count() == 0
