import __spark_entry__ as entry
from lexigrove import workload


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["doc_id", "score", "hits"] and df.count() > 0


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(workload.QUERIES) <= set(queries)
    assert all(map(callable, queries.values()))
