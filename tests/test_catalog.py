"""Every query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from folioframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_duckdb(spark, duck, data, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    r = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(plain(row[names.index(c)]) for c in cols)) for row in r.fetchall())
    got = sorted(str(tuple(plain(row[c]) for c in cols)) for row in df.collect())
    assert got == want
    assert got, "a query without rows checks nothing"


def test_every_query_is_known():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_filled_boxes_without_a_join(spark):
    from folioframe.plans import catalog

    plan = catalog.queries()["x11_filled_rects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
