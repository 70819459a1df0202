import __spark_entry__ as registered


def test_every_sql_belongs_to_a_query():
    queries, sql = registered.queries(), registered.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 90 and "seeded_selection" in queries


def test_entry_runs(spark):
    out = registered.entry(spark)
    assert out.columns == ["source", "doc_id", "status", "reasons", "rank", "split"] and out.count() > 0
