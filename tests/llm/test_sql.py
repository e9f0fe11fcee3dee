"""Queries of the subpackage against their SQL."""

import duckdb
import pytest

from nearfield.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, relation = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    want = sorted(tuple(r[relation.columns.index(c)] for c in columns) for r in relation.fetchall())
    assert got == want
