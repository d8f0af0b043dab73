"""Every query against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from granary.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(columns).collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted(([plain(v) for v in r] for r in rel.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == want
