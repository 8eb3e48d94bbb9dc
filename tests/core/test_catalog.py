import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
    assert entry.entry and all(callable(f) for f in q.values())
