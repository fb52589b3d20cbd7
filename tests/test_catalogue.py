"""Every query with SQL against DuckDB on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from notegrove.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {Path(f).stem} as select * from '{f}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: round(float(v), 5) if isinstance(v, float) or hasattr(v, "quantize") else str(v)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df, want = catalogue.queries()[name](spark, SF), db.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
