"""Every registered query against its SQL on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from pagelight.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return str(v) if type(v).__name__ in ("Decimal", "datetime") else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in Q.ORACLES:
        assert got
        return
    r = duck.sql(Q.ORACLES[name])
    names = r.columns
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
