"""Every query runs over the smallest tables and, where it has SQL, gives the same rows."""

import datetime
import decimal
import functools
import glob
import math
import os

import duckdb
import pytest

from scriptorium.plans import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str([str(plain(r[k])) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.fixture(scope="module", autouse=True)
def built_once():
    """The graph, its groups and communities and what the write step makes are the same for all queries."""
    kept = {name: getattr(catalog, name) for name in ("_graph", "_settled", "_grouped", "_written")}
    for name, f in kept.items():
        setattr(catalog, name, functools.lru_cache(f))
    yield
    for name, f in kept.items():
        setattr(catalog, name, f)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, D)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.SQL:
        found = db.execute(catalog.SQL[name])
        assert got == table([x[0] for x in found.description], found.fetchall())
