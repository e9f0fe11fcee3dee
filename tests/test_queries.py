"""Every registered query against its SQL twin in DuckDB, and plan properties."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from nearfield.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else round(v, 6)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(canon(r[k]) for k in order) for r in rows], key=str)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf, name):
    df = QUERIES[name](spark, sf)
    relation = duck(sf).sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(relation.columns, relation.fetchall())
    assert len(got) == len(want) and got
    if got != want:
        key = lambda r: tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r)
        for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
            assert all(close(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_rows_only(spark, sf, name):
    first = sorted(map(str, QUERIES[name](spark, sf).collect()))
    assert first and first == sorted(map(str, QUERIES[name](spark, sf).collect()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_searches_do_not_shuffle_observations(spark, sf):
    """Queries travel to the observations: only the best candidates of each task are exchanged."""
    plan = QUERIES["knn_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_calibrated_posterior_searches_once(spark, sf):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["calibrated_posterior"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan
