"""Nearest neighbours: a top-k join on squared distance, ties to the smaller row id.

Three strategies give equal results:

* ``sql`` takes distances and ranks in the JVM: of all pairs, up to ``SQL_PAIRS`` of them, and beyond
  that of the pairs that one of the other searches finds, and of all pairs with a null inside.
* ``block`` broadcasts the queries as one array, only while they and the k rows that a task keeps
  for each fit ``BROADCAST_BYTES``; each partition of the observations keeps its own k best for every
  query in Arrow batches, and a window over partitions x k candidates ranks these.  Observations are
  read once and not moved.
* ``grid`` is for more queries than that: queries, with their k rows, and observations are dealt into
  blocks of 16 MB at most, or smaller ones to make a task for each shuffle partition, and the k best
  of every pair of blocks are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearfield.functions.expr import doubles, sq_l2

BROADCAST_BYTES = 64 << 20
GRID_BYTES = 16 << 20
SQL_PAIRS = 20_000_000
SELF_D2 = 1e-15
CELLS = 1 << 20
#: Rows of one matrix product of ``CELLS`` pairs, pairs compared by differences at a time, and bytes
#: of rows that are collected before they are compared.
ROW_BLOCK, PAIRS, HELD_BYTES = 2048, 1 << 14, 8 << 20


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as float64 of shape (n, width)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pc.all(pc.equal(pc.list_value_length(column), width), skip_nulls=False, min_count=0).as_py():
        raise ValueError(f"every x must have {width} components")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), width)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by differences (not by a product, so that equal rows are at 0)."""
    if 0 < len(q) * len(x) * q.shape[1] <= PAIRS:  # the same sum, in fewer calls
        d = q[:, None, :] - x[None, :, :]
        return np.add.accumulate(d * d, axis=2)[:, :, -1]
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        d = q[:, j, None] - x[None, :, j]
        out += d * d
    return out


class TopK:
    """The k best (d2, id) of every query, over any number of batches.

    A matrix product gives a lower bound of each distance, rounding included; only pairs whose bound
    lies within the query's k-th distance so far are compared by differences.  On a line the k next
    rows on both sides are found in sorted order.  Of rows with equal x the k smallest ids are
    enough.  Memory is the queries, k rows for each, and blocks of fixed size.
    """

    def __init__(self, queries: np.ndarray, k: int, reach: np.ndarray | None = None) -> None:
        """With ``reach`` only rows within that squared distance of a query are wanted."""
        self.q, self.k = np.ascontiguousarray(queries, float), k
        self.d2 = np.full((len(queries), k), np.nan)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.n = np.zeros(len(queries), np.int64)
        self.reach = np.full(len(queries), np.inf) if reach is None else np.array(reach, float)
        self.norm = (self.q * self.q).sum(axis=1)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray, ids: np.ndarray, at: np.ndarray | None = None) -> None:
        """Rows for all queries, or for those at the positions ``at``."""
        if at is not None:
            self._compare(*self._without_copies(x, ids), at)
            return
        self.held.append((x, ids))
        if sum(h.nbytes for h, _ in self.held) >= HELD_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        x, ids = (np.concatenate(part) for part in zip(*self.held))
        self.held = []
        x, ids = self._without_copies(x, ids)
        if x.shape[1] == 1 and np.isfinite(x).all() and np.isfinite(self.q).all():
            self._line(x[:, 0], ids)
        else:
            self._compare(x, ids)

    def _without_copies(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(x) <= self.k or len(self.q) < 64 or not x.shape[1]:
            return x, ids
        flat = np.ascontiguousarray(x + 0.0)  # -0.0 becomes 0.0
        distinct, which = np.unique(flat.ravel() if x.shape[1] == 1 else flat.view(np.dtype((np.void, flat.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        if len(distinct) == len(x):
            return x, ids
        order = np.lexsort((ids, which))
        group = which[order]
        order = order[np.arange(len(order)) - np.searchsorted(group, group) < self.k]
        return x[order], ids[order]

    def _line(self, v: np.ndarray, ids: np.ndarray) -> None:
        sides = [(sign, np.lexsort((ids, sign * v))) for sign in (1.0, -1.0)]
        step = max(1, CELLS // (4 * (self.k + 1)))
        for a in range(0, len(self.q), step):
            q, many = self.q[a : a + step, 0], np.zeros(len(self.q[a : a + step]), bool)
            found = []
            for sign, order in sides:
                line = sign * v[order]
                first = np.searchsorted(line, sign * q, "left" if sign > 0 else "right")
                take = first[:, None] + np.arange(self.k + 1)
                there = take < len(line)
                take = order[np.minimum(take, len(line) - 1)]
                d = q[:, None] - v[take]
                d2 = np.where(there, d * d, np.inf)
                # distances that only rounding makes equal are not in the order of ids
                last = self.k - 1
                many |= there[:, -1] & (d2[:, -1] == d2[:, last]) & ((d2[:, :-1] == d2[:, -1:]) & (v[take[:, :-1]] != v[take[:, -1:]])).any(axis=1)
                there[:, -1] = False
                i, j = np.nonzero(there & ~(d2 > self.reach[a : a + step, None]))
                found.append((i, d2[i, j], ids[take[i, j]]))
            i, d2, near = (np.concatenate(part) for part in zip(*found))
            use = ~many[i]
            self._merge(i[use] + a, d2[use], near[use])
            if many.any():
                self._compare(v[:, None], ids, np.flatnonzero(many) + a)

    def _compare(self, x: np.ndarray, ids: np.ndarray, at: np.ndarray | None = None) -> None:
        width = x.shape[1]
        norm = (x * x).sum(axis=1)
        slack = 8 * (width + 8) * np.finfo(float).eps
        count = len(self.q) if at is None else len(at)
        for b in range(0, len(x), ROW_BLOCK):
            xs, far = x[b : b + ROW_BLOCK], norm[b : b + ROW_BLOCK]
            right = np.concatenate([xs, (1 - slack) * far[:, None]], axis=1).T
            step = max(1, CELLS // max(len(xs), self.k))
            for a in range(0, count, step):
                here = np.arange(a, min(a + step, count)) if at is None else at[a : a + step]
                q, near, reach = self.q[here], self.norm[here], self.reach[here]
                low = np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1) @ right
                limit = reach - (1 - slack) * near + slack * (reach + near)
                open_ = np.flatnonzero(np.isposinf(reach))
                if len(open_) and len(xs) > self.k:
                    kth = np.partition(low[open_], self.k - 1, axis=1)[:, self.k - 1]
                    limit[open_] = kth + 2 * slack * (near[open_] + far.max())
                over = low > limit[:, None]
                pairs = np.flatnonzero(np.logical_not(over, out=over))
                for c in range(0, len(pairs), PAIRS):
                    i, j = np.divmod(pairs[c : c + PAIRS], len(xs))
                    d = q[i] - xs[j]
                    d *= d
                    # one component after the other, as a plain sum
                    d2 = np.add.accumulate(d, axis=1, out=d)[:, -1].copy() if width else np.zeros(len(i))
                    use = ~(d2 > self.reach[here[i]])
                    self._merge(here[i[use]], d2[use], ids[b + j[use]])

    def _merge(self, at: np.ndarray, d2: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        rows, which = np.unique(at, return_inverse=True)
        old, slot = np.nonzero(np.arange(self.k) < self.n[rows, None])
        which = np.concatenate([old, which])
        d2 = np.concatenate([self.d2[rows[old], slot], d2])
        ids = np.concatenate([self.ids[rows[old], slot], ids])
        order = np.lexsort((ids, d2, which))
        which = which[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        best = rank < self.k
        which, rank, order = which[best], rank[best], order[best]
        self.d2[rows[which], rank], self.ids[rows[which], rank] = d2[order], ids[order]
        self.n[rows] = np.bincount(which, minlength=len(rows))
        full = rows[self.n[rows] == self.k]
        self.reach[full] = np.fmin(self.reach[full], self.d2[full, -1])

    def rows(self, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, id, d2) of all queries, or of those from ``first`` on and before ``last``."""
        self._flush()
        at, slot = np.nonzero(np.arange(self.k) < self.n[first:last, None])
        at += first
        return at, self.ids[at, slot], self.d2[at, slot]

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same in parts of about ``CELLS`` rows."""
        step = max(1, CELLS // self.k)
        for a in range(0, len(self.q), step):
            yield self.rows(a, a + step)


def without_self(ranked: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Of rows ranked to k + 1, the k that are left without the first at distance zero, if there is one."""
    self_rank = F.min(F.when(F.col("d2") <= SELF_D2, F.col("rank"))).over(Window.partitionBy(key))
    out = ranked.withColumn("self_rank", self_rank).where(F.col("self_rank").isNull() | (F.col("rank") != F.col("self_rank")))
    return out.withColumn("rank", F.when(F.col("rank") > F.col("self_rank"), F.col("rank") - 1).otherwise(F.col("rank"))).drop("self_rank").where(F.col("rank") <= k)


def _ranked(candidates: DataFrame, k: int, exclude_self: bool, key: str) -> DataFrame:
    """Rank (key, row_id, d2) and take out one row at distance zero, the first, if asked."""
    w = Window.partitionBy(key).orderBy("d2", "row_id")
    out = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + int(exclude_self))
    return without_self(out, k, key) if exclude_self else out


def _sql_pairs(q: DataFrame, o: DataFrame, pool: int, scale: Sequence[float] | None) -> DataFrame:
    """``(query_id, row_id, d2)`` of pairs, with the ``pool`` nearest of every query among them."""
    d2 = sq_l2(F.col("qx"), F.col("x"), scale).alias("d2")
    n = q.count()
    first = q.select(F.size("qx").alias("d")).where("d > 0").first() if n * o.count() > SQL_PAIRS else None
    if not first:
        return q.crossJoin(o).select("query_id", "row_id", d2)
    width = first["d"]
    sent = F.broadcast if n * (width + 1) * 8 <= BROADCAST_BYTES else lambda df: df

    def odd(x: str) -> Column:
        """Rows of another width or with nulls, which the other searches refuse."""
        return F.coalesce((F.size(x) != width) | F.exists(x, lambda v: v.isNull()), F.lit(True))

    even_q, even_o = q.where(~odd("qx")), o.where(~odd("x"))
    near = knn(even_q.withColumnRenamed("qx", "x"), even_o, pool, scale=scale).select(F.col("query_id").alias("n_query"), F.col("row_id").alias("n_row"))
    if n * pool * 64 <= BROADCAST_BYTES:
        near = F.broadcast(near)  # then the observations are not moved
    near = even_o.join(near, F.col("row_id") == F.col("n_row")).join(sent(even_q), F.col("n_query") == F.col("query_id")).select("query_id", "row_id", d2)
    for a, b in ((q.where(odd("qx")), o), (even_q, o.where(odd("x")))):
        near = near.unionByName(b.crossJoin(sent(a)).select("query_id", "row_id", d2))
    return near


def knn(
    queries: DataFrame,
    observations: DataFrame,
    k: int,
    *,
    scale: Sequence[float] | None = None,
    exclude_self: bool = False,
    strategy: str | Callable[..., DataFrame] = "auto",
    blocks: int | None = None,
) -> DataFrame:
    """``queries(query_id, x)`` x ``observations(row_id, x)`` -> ``(query_id, rank, row_id, d2)``.

    Ranks run from 1 to at most k.  With ``scale`` both sides are divided by it first.
    ``exclude_self`` drops one row at distance zero for each query that has one, and none for the
    others.  k = 0 or no observations give an empty result; k < 0 is an error.  A callable strategy
    is a search of its own, over an index: ``(queries, k, scale, exclude_self)``.
    """
    if k < 0:
        raise ValueError(f"k must be >= 0, got {k}")
    if callable(strategy):
        return strategy(queries, k, scale, exclude_self)
    spark = queries.sparkSession
    q = queries.select("query_id", doubles(F.col("x")).alias("qx"))
    o = observations.select("row_id", doubles(F.col("x")).alias("x"))
    schema = T.StructType([queries.schema["query_id"], T.StructField("row_id", T.LongType()), T.StructField("d2", T.DoubleType())])
    if k == 0:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).select("query_id", "rank", "row_id", "d2")
    pool = k + int(exclude_self)
    s = np.asarray(scale, float) if scale is not None else None

    if strategy in ("auto", "block"):
        first = q.select(F.size("qx").alias("d")).first()
        width = first["d"] if first else 0
        if strategy == "auto":
            strategy = "block" if q.count() * (width + 1 + 2 * pool) * 8 <= BROADCAST_BYTES else "grid"

    if strategy == "sql":
        return _ranked(_sql_pairs(q, o, pool, scale), k, exclude_self, "query_id").select("query_id", "rank", "row_id", "d2")

    if strategy == "block":
        table = q.toArrow()
        if not len(table):
            return spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).select("query_id", "rank", "row_id", "d2")
        block = matrix(table.column("qx"), width)
        if block.nbytes > BROADCAST_BYTES:
            raise ValueError("too many queries to broadcast; take strategy='grid'")
        block, pos = np.unique(block / s if s is not None else block, axis=0, return_inverse=True)  # equal queries are searched once
        held = spark.sparkContext.broadcast(block)
        names = table.column("query_id").combine_chunks()

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = TopK(held.value, pool)
            for batch in batches:
                x = matrix(batch.column(1), width)
                top.add(x / s if s is not None else x, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for at, ids, d2 in top.parts():
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids), pa.array(d2)], names=["q", "row_id", "d2"])

        found = o.mapInArrow(best, "q long, row_id long, d2 double")
        ranked = _ranked(found, k, exclude_self, "q")
        ids = spark.createDataFrame(pd.DataFrame({"pos": pos.ravel(), "query_id": names.to_pandas()})).select(F.col("pos"), F.col("query_id").cast(queries.schema["query_id"].dataType))
        return ranked.join(F.broadcast(ids), F.col("q") == F.col("pos")).select("query_id", "rank", "row_id", "d2")

    if strategy != "grid":
        raise ValueError(f"no strategy {strategy!r}")

    def blocks_of(df: DataFrame, x: str, more: int) -> int:
        return -(-(df.agg(F.sum(8 * (F.size(x) + 1 + more))).first()[0] or 0) // GRID_BYTES)

    n_q = blocks or max(2, blocks_of(q, "qx", 2 * pool))
    n_o = blocks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_q, blocks_of(o, "x", 0))
    left = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("ob", F.explode(F.sequence(F.lit(0), F.lit(n_o - 1))))
    right = o.withColumn("ob", F.pmod(F.xxhash64("row_id"), F.lit(n_o)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def pair(qs: pa.Table, xs: pa.Table) -> pa.Table:
        names, at = qs.column("query_id"), np.zeros(0, np.int64)
        ids, d2 = at, np.zeros(0)
        if len(qs) and len(xs):
            width = len(qs.column("qx")[0])
            a, b = matrix(qs.column("qx"), width), matrix(xs.column("x"), width)
            top = TopK(a / s if s is not None else a, pool)
            top.add(b / s if s is not None else b, xs.column("row_id").to_numpy().astype(np.int64))
            at, ids, d2 = top.rows()
        return pa.table({"query_id": names.take(pa.array(at)), "row_id": ids, "d2": d2})

    found = left.groupBy("qb", "ob").cogroup(right.groupBy("qb", "ob")).applyInArrow(pair, schema)
    return _ranked(found, k, exclude_self, "query_id").select("query_id", "rank", "row_id", "d2")


def knn_conditional(queries: DataFrame, observations: DataFrame, whatif: DataFrame, k: int, **options: object) -> DataFrame:
    """Neighbours among observations and hypothetical rows, which ``whatif`` gives with row ids
    beyond those observed."""
    return knn(queries, observations.select("row_id", "x").unionByName(whatif.select("row_id", "x")), k, **options)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the mean share of the exact neighbours that were found."""
    a = found.groupBy("query_id").agg(F.collect_set("row_id").alias("got"))
    b = exact.groupBy("query_id").agg(F.collect_set("row_id").alias("want")).withColumnRenamed("query_id", "q")
    joined = b.join(a, F.col("q") == F.col("query_id"), "left")
    hit = F.size(F.array_intersect(F.coalesce("got", F.array().cast("array<bigint>")), "want"))
    return joined.agg(F.avg(hit / F.size("want")).alias("recall"))
