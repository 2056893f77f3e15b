from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import compare, views

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "f1", "tp", "fp", "fn"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name, tmp_path):
    """Against the SQL; a query without SQL is written with all its columns, none of which may be empty throughout."""
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert compare(spark, query, sql, SMALL, views(SMALL)) == ""
        return
    df = query(spark, SMALL)
    df.write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").toPandas()
    assert list(rows.columns) == df.columns and len(rows) > 0
    assert [c for c in rows.columns if rows[c].isna().all()] == []
