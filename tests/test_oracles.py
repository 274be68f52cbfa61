"""Every query that SQL can express gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
catalog.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)

    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x == int(x) else x

    return cols, sorted(repr([plain(x) for x in r]) for r in frame[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() >= 1


@pytest.mark.parametrize("name", ["merge_on_read", "snapshot_read_intents", "isolation_verdicts", "recovered_version_order"])
def test_partition_count_changes_nothing(spark, name):
    want = None
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = rows(catalog.QUERIES[name](spark, SF).toPandas())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        want = want or got
        assert got == want


def test_entry_has_a_verdict_for_each_history(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["history_id", "valid", "anomalies"]
    assert out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
