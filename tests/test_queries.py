"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestone import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert got
    if name in catalog.ORACLES:
        rel = sql.execute(catalog.ORACLES[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
        assert got == want
