"""Every registered query with an oracle equals DuckDB on the smallest data."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_registry_shape():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, duck, key):
    from tools.check_oracle import frame_hash
    df = E.queries()[key](spark, SF_SMALL)
    from pyspark.sql import types as T
    assert not [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))], "scalar outputs only"
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[key])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert frame_hash(df.columns, rows)[0] == frame_hash(rel.columns, drows)[0]


def test_rows_only_queries_run(spark):
    for key in sorted(set(E.queries()) - set(E.oracle_sql())):
        assert E.queries()[key](spark, SF_SMALL).count() >= 0, key
