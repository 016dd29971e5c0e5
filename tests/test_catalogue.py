"""Every query that has SQL equals it on the tables of the check."""

import os
from pathlib import Path

import pytest

from verlog.plans import catalogue

DATA = Path("/root/testdata/sf0.01")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA / f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_sql(spark, db, name):
    df = catalogue.queries()[name](spark, str(DATA))
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    if name in catalogue.oracle_sql():
        rel = db.sql(catalogue.oracle_sql()[name])
        order = [rel.columns.index(c) for c in sorted(df.columns)]
        assert got == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
    else:
        assert got
