"""Every registered query of the layout operators against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

from pagewright import queries, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_all_modules_are_registered():
    assert len(registry.QUERIES) > 100 and all(f.__module__.startswith("pagewright.queries.") for f in registry.QUERIES.values()) and queries.__all__


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", [n for n in sorted(registry.ORACLES) if n in os.environ.get("ONLY", n).split(",")])
def test_same_as_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    cur = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    expect = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(expect)
    for a, b in zip(got, expect):
        assert a == b and [type(x) for x in a] == [type(x) for x in b]
