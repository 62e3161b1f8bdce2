"""Every query of the plans against its SQL in DuckDB, over whole small tables."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from attestra.plans import preparing, queries, review, trials  # noqa: F401


def plain(v):
    if isinstance(v, Decimal):
        return format(v.normalize(), "f")
    return v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(name, spark, sf, db):
    df = queries.QUERIES[name](spark, sf)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got
    if name in queries.ORACLE_SQL:
        rel = db.sql(queries.ORACLE_SQL[name])
        at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert [rel.columns[i] for i in at] == sorted(df.columns)
        want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
