"""Every query with an SQL form equals it on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from ratiosift.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in row) for row in df.select(*columns).collect()]
    result = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r.name for r in rows if r.is_true} == {"x0", "x1^(-1)"}
