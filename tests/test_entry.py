import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(sql) > 50


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_stream(spark):
    from quire import queries

    found = queries.streamed_chunks(spark, "/root/testdata/sf0.001")
    assert found.count() == 50
