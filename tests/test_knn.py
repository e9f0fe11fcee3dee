"""The k best of a task: equal to sorting all pairs, in bounded memory, without all pairs on a line."""

import tracemalloc

import numpy as np
import pytest

from nearfield.operators import knn as search
from nearfield.operators.knn import TopK, distances


def best(q, x, ids, k):
    d2 = distances(q, x)
    return [[(str(d2[i, j]), int(ids[j])) for j in np.lexsort((ids, d2[i]))[:k]] for i in range(len(q))]


def found(top):
    out = [[] for _ in top.q]
    for at, row, d2 in zip(*top.rows()):
        out[at].append((str(d2), int(row)))
    return out


@pytest.mark.parametrize("width", [1, 3])
@pytest.mark.parametrize("kind", ["normal", "grid", "one point", "rounding", "missing"])
def test_ties_copies_and_missing_numbers(kind, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(700, width))
    if kind == "grid":
        x = np.round(x)
    elif kind == "one point":
        x = x * 0
    elif kind == "rounding":
        x = 1e8 + 1e-8 * np.round(3 * x)
    elif kind == "missing":
        x[rng.random(len(x)) < 0.99] = np.nan
    q, ids = np.concatenate([x[:90], x[:30] + 0.5]), rng.permutation(3000)[: len(x)]
    for k in (1, 7, 900):
        top = TopK(q, k)
        for a in range(0, len(x), 160):
            top.add(x[a : a + 160], ids[a : a + 160])
        assert found(top) == best(q, x, ids, k)


def test_a_line_needs_no_pairs(monkeypatch):
    rng = np.random.default_rng(0)
    x, q = rng.integers(0, 500, 200_000) / 8.0, rng.random(3_000) * 70
    monkeypatch.setattr(TopK, "_compare", lambda *a: pytest.fail("all pairs are compared"))
    top = TopK(q[:, None], 10)
    top.add(x[:, None], np.arange(len(x)))
    at, ids, d2 = top.rows()
    assert len(at) == 30_000
    want = best(q[:5, None], x[:, None], np.arange(len(x)), 10)
    assert [[(str(b), int(a)) for a, b in zip(ids[at == i], d2[at == i])] for i in range(5)] == want


def test_memory_of_many_queries():
    """30,000 queries of 16 numbers and the 10 best of each are 9 MB."""
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(30_000, 16)), rng.normal(size=(2_000, 16))
    tracemalloc.start()
    top = TopK(q, 10)
    top.add(x, np.arange(len(x)))
    assert len(top.rows()[0]) == 300_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6, peak


@pytest.mark.parametrize("exclude_self", [False, True])
def test_sql_without_all_pairs(spark, monkeypatch, exclude_self):
    """The same rows as from all pairs, with ties, copies, NaN, nulls and other widths among them."""
    rng = np.random.default_rng(3)
    x = [[float(v) for v in row] for row in np.round(2 * rng.normal(size=(600, 3)))]
    x[20], x[41], x[60], x[75], x[80] = [float("nan"), 0.0, 1.0], None, None, [1.0, None, 0.0], [1.0, 2.0]
    o = spark.createDataFrame(list(enumerate(x)), "row_id long, x array<double>").repartition(3)
    q = o.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    found = lambda: search.knn(q, o, 4, scale=[1.0, 2.0, 3.0], exclude_self=exclude_self, strategy="sql")
    want = sorted(map(str, found().collect()))
    monkeypatch.setattr(search, "SQL_PAIRS", 0)
    assert sorted(map(str, found().collect())) == want and len(want) == 4 * 30


def test_sql_of_many_rows_joins_no_pairs(spark):
    o = spark.range(200_000).selectExpr("id as row_id", "array(double(id % 977), double(id % 31)) as x")
    q = o.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    plan = search.knn(q, o, 5, strategy="sql")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "MapInArrow" in plan


def test_blocks_of_the_grid_are_bounded(spark, monkeypatch, tmp_path):
    """However many rows there are and however few shuffle partitions, a task holds blocks of fixed size."""
    log = str(tmp_path / "sizes")

    class Logged(TopK):
        def add(self, x, ids, at=None):
            with open(log, "a") as f:
                f.write(f"{len(self.q)} {len(x)}\n")
            super().add(x, ids, at)

    x = np.round(np.random.default_rng(1).normal(size=(3_000, 4)), 1)
    o = spark.createDataFrame(list(enumerate(x.tolist())), "row_id long, x array<double>")
    q = o.where("row_id % 20 = 0").selectExpr("string(row_id) as query_id", "x")
    monkeypatch.setattr(search, "TopK", Logged)
    monkeypatch.setattr(search, "GRID_BYTES", 1 << 13)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = search.knn(q, o, 5, strategy="grid").orderBy("query_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = best(x[::20], x, np.arange(len(x)), 5)
    assert [(r.query_id, str(r.d2), r.row_id) for r in got] == [(i, *row) for i in sorted(map(str, range(0, 3_000, 20))) for row in want[int(i) // 20]]
    queries, rows = np.loadtxt(log, int).max(axis=0)
    assert queries * (4 + 1 + 2 * 5) * 8 < 1.6 * (1 << 13) and rows * (4 + 1) * 8 < 1.6 * (1 << 13), (queries, rows)


def test_rows_kept_for_queries_count_as_broadcast(spark, monkeypatch):
    """1,000 queries of one number are 16 kB, the 50 rows that a task keeps for each are 800 kB."""
    o = spark.range(2_000).selectExpr("id as row_id", "array(double(id % 977)) as x")
    q = o.where("row_id % 2 = 0").withColumnRenamed("row_id", "query_id")
    plan = lambda k: search.knn(q, o, k)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 100_000)
    assert "MapInArrow" in plan(2) and "MapInArrow" not in plan(50)


def test_rows_of_other_widths_are_refused():
    mixed = search.pa.array([[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]])
    with pytest.raises(ValueError, match="3 components"):
        search.matrix(mixed, 3)
    with pytest.raises(ValueError, match="2 components"):
        search.matrix(search.pa.array([[1.0, 2.0], None]), 2)
    lists = search.pa.list_(search.pa.float64())
    assert search.matrix(search.pa.array([[], []], lists), 0).shape == (2, 0)
    assert search.matrix(search.pa.array([], lists), 3).shape == (0, 3)


def test_parts_are_all_rows(monkeypatch):
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(100, 3)), rng.normal(size=(500, 3))
    top = TopK(q, 7)
    top.add(x, np.arange(500))
    monkeypatch.setattr(search, "CELLS", 50)
    parts = list(top.parts())
    assert max(len(p[0]) for p in parts) <= 50
    assert [np.concatenate(c).tolist() for c in zip(*parts)] == [c.tolist() for c in top.rows()]
