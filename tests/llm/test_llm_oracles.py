"""Registered queries against their SQL on the smallest tables."""

import pytest

from daygrid.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
