"""Training-data queries that SQL can state, against DuckDB on the smallest tables."""

import duckdb
import pytest

from folioframe.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_duckdb(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    r = c.execute(llm.oracle_sql()[name])
    names = [x[0] for x in r.description]
    df = llm.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    got = sorted(map(str, (tuple(row[n] for n in names) for row in df.collect())))
    assert got == sorted(map(str, r.fetchall())) and got
