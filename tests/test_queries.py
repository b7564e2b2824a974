"""Every registered query of the reference's operators against its SQL."""

import math
import os

import duckdb
import pytest

from cordon import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(df):
    fix = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(fix, r)) for r in df[cols].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        assert plain(got) == plain(con.sql(queries.ORACLE_SQL[name]).df())
    else:
        assert len(got.columns) > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
