"""Every query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from strandline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name in catalogue.oracle_sql():
        rel = con.sql(catalogue.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        place = [rel.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=str)
