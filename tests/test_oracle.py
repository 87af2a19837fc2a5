"""Every registered query vs its DuckDB oracle at sf0.001 (driver-style)."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from paths import SF_SMALL

QUERIES = entry.queries()
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name in SQLS:
        res = compare(df, SQLS[name], con)
        assert res["ok"], res
    else:
        assert df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns
