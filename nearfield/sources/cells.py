"""A tree of cells over observations, and a neighbour search that reads only cells that can matter.

Every row lies in the leaf that its nearest pivots lead to, level by level; a leaf knows its pivot,
its radius (the greatest distance of a row from the pivot) and its number of rows.  No row of a leaf
is nearer to a query than distance(query, pivot) - radius, so a search takes the nearest leaves that
hold k rows, and with the k-th distance found there reads every further leaf whose bound lies within
it: the result is exact.  With a ``budget`` only that many nearest leaves are read.

On disk: ``rows-*`` holds ``(cell, chunk, row_id, x)`` sorted by cell, so that the filter on cells
prunes files and row groups; ``tree-*`` the cells; ``manifest.json``, written last, names them.
Rows that a split moves are written again under their new cells, and what lies under a cell that is
no leaf any more is not read.  Pivots come from a sample of at most some ``SAMPLE_BYTES`` of rows a
level; every row is indexed.  The pivots of all cells stay below ``BROADCAST_BYTES``.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.expr import doubles
from nearfield.operators.knn import BROADCAST_BYTES, CELLS, TopK, _ranked, distances, knn, matrix
from nearfield.sources.scratch import written
from nearfield.sources.store import Files

SAMPLE_BYTES = 32 << 20
CELL_ROWS = 4096
CHUNK_ROWS = 1 << 16
FANOUT = 64
#: A leaf is split once it holds this many times the rows it should.
OVERFULL = 4
#: More wanted cells than this are not written into the scan's filter.
FILTER_CELLS = 10_000
ROW_SCHEMA = "cell long, chunk int, row_id long, x array<double>"
TREE_SCHEMA = "cell long, parent long, pivot array<double>, radius double, n long, chunks int"


def leaf_budget(n: int) -> int:
    """Leaves that an approximate search of n rows reads at the most: it grows as ln n."""
    return math.ceil(128 * math.log(max(n, 2)))


@dataclass
class Leaf:
    pivot: np.ndarray
    radius: float
    n: int
    chunks: int = 1


@dataclass
class Leaves:
    """All leaves as arrays, in the scale of a search."""

    ids: np.ndarray
    pivots: np.ndarray
    radius: np.ndarray
    n: np.ndarray

    def reaches(self, d: np.ndarray, leaf: np.ndarray | int, far: np.ndarray, last: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Whether leaves at distance d, behind the last one that a query has read, may hold rows
        within the squared distance."""
        read = (d < far) | (d == far) & (leaf <= last)
        reach = np.sqrt(within)
        return ~read & (d - self.radius[leaf] <= reach + 1e-9 * (reach + d + self.radius[leaf]))


def _near(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every query to every pivot, a block of queries at a time."""
    step = max(1, CELLS // max(1, len(pivots)))
    return np.sqrt(np.concatenate([distances(q[a : a + step], pivots) for a in range(0, len(q), step)])) if len(q) else np.zeros((0, len(pivots)))


def _pivots(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` centres of distinct points: spread over them, then moved to their means twice."""
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)]
    for _ in range(2):
        at = _near(points, centres).argmin(axis=1)
        size = np.bincount(at, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def descend(children: dict[int, tuple[np.ndarray, np.ndarray]], start: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, distance from its pivot) of rows that begin at the cells ``start``; the distance is
    from the origin where no cell has children."""
    cell, far = start.copy(), np.sqrt((x * x).sum(axis=1))
    open_ = [(int(c), np.flatnonzero(start == c)) for c in np.unique(start)]
    while open_:
        c, at = open_.pop()
        if c not in children:
            cell[at] = c
            continue
        ids, pivots = children[c]
        d = _near(x[at], pivots)
        best = d.argmin(axis=1)
        far[at] = d[np.arange(len(at)), best]
        open_ += [(int(ids[j]), at[best == j]) for j in np.unique(best)]
    return cell, far


class CellIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.files = Files(spark)
        self.children: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.leaves: dict[int, Leaf] = {}
        self.parts: list[str] = []
        self.scale = np.ones(0)
        self.cell_rows, self.next_id = CELL_ROWS, 1
        self.cells_read = self.rows_read = 0  # of the last search

    # -- building

    @classmethod
    def build(cls, observations: DataFrame, path: str, *, scale: Sequence[float] | None = None, cell_rows: int = CELL_ROWS) -> CellIndex:
        """Index ``observations(row_id, x)``.  An empty table gives an index without rows."""
        self = cls(observations.sparkSession, path)
        o = observations.select("row_id", doubles(F.col("x")).alias("x"))
        first = o.select(F.size("x").alias("d")).first()
        width = first["d"] if first else len(scale or ())
        self.scale = np.ones(width) if scale is None else np.asarray(scale, float)
        self.cell_rows = int(cell_rows)
        n = o.count()
        self.leaves = {0: Leaf(np.zeros(width), np.inf, n)} if n else {}
        if n:
            self._grow(o.withColumn("cell", F.lit(0).cast("long")), {0})
            self._write(o.withColumn("cell", F.lit(0).cast("long")))
        self._commit()
        return self

    @property
    def n(self) -> int:
        return sum(leaf.n for leaf in self.leaves.values())

    def _descended(self, rows: DataFrame) -> DataFrame:
        """``rows(cell, row_id, x)`` with the leaf below their cell, its chunk and their distance."""
        width, scale = len(self.scale), self.scale
        held = self.spark.sparkContext.broadcast((self.children, {c: leaf.chunks for c, leaf in self.leaves.items()}))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            children, chunks = held.value
            for b in batches:
                x = matrix(b.column(2), width) / scale
                cell, far = descend(children, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), x)
                of = np.array([chunks.get(int(c), 1) for c in cell], np.int64)
                ids = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array((ids % of).astype(np.int32)), b.column(1), b.column(2), pa.array(far)], names=["cell", "chunk", "row_id", "x", "far"])

        return rows.select("cell", "row_id", "x").mapInArrow(walk, f"{ROW_SCHEMA}, far double")

    def _stats(self, rows: DataFrame) -> dict[int, tuple[int, float]]:
        """(rows, greatest distance) a leaf: one partial aggregation, a row a leaf to the driver."""
        out = self._descended(rows).groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"))
        return {r["cell"]: (r["n"], r["r"]) for r in out.collect()}

    def _grow(self, rows: DataFrame, over: set[int]) -> None:
        """Split the leaves ``over`` until none holds more than ``cell_rows``, none can be told
        apart any more, or no further pivots may be held."""
        width, level = len(self.scale), 0
        while over:
            level += 1
            total = sum(self.leaves[c].n for c in over)
            share = min(1.0, SAMPLE_BYTES / (8 * (width + 2)) / total)
            picked = rows.where(F.pmod(F.xxhash64("row_id", F.lit(level)), F.lit(1 << 30)) < int(share * (1 << 30)))
            sample = self._descended(picked).where(F.col("cell").isin(sorted(over))).select("cell", "x").toArrow()
            at = sample.column("cell").to_numpy()
            points = matrix(sample.column("x"), width) / self.scale
            room = BROADCAST_BYTES // (8 * (width + 4)) - self.next_id
            wanted = {c: min(FANOUT, -(-self.leaves[c].n // self.cell_rows)) for c in over}
            tight = min(1.0, room / max(1, sum(wanted.values())))
            grown = set()
            for c in sorted(over):
                mine = np.unique(points[at == c], axis=0)
                count = min(int(wanted[c] * tight), len(mine))
                centres = _pivots(mine, count) if count > 1 else mine[:0]
                if len(centres) < 2:
                    continue
                ids = np.arange(self.next_id, self.next_id + len(centres))
                self.next_id += len(centres)
                self.children[c] = (ids, centres)
                del self.leaves[c]
                self.leaves |= {int(i): Leaf(p, 0.0, 0) for i, p in zip(ids, centres)}
                grown |= {int(i) for i in ids}
            if not grown:
                break
            for c, (n, far) in self._stats(rows).items():
                if c in grown:
                    self.leaves[c].n, self.leaves[c].radius = n, far
            self._prune(grown)
            over = {c for c in grown if c in self.leaves and self.leaves[c].n > self.cell_rows and self.leaves[c].radius > 0}
        for leaf in self.leaves.values():
            if not leaf.n or leaf.radius == np.inf:
                continue
            leaf.chunks = max(leaf.chunks, -(-leaf.n // CHUNK_ROWS))
        for leaf in self.leaves.values():  # a root that was never split
            if leaf.radius == np.inf:
                leaf.radius = next(iter(self._stats(rows).values()))[1]
                leaf.chunks = -(-leaf.n // CHUNK_ROWS)

    def _prune(self, fresh: set[int]) -> None:
        """Forget leaves that no row chose."""
        empty = {c for c in fresh if not self.leaves[c].n}
        for c in empty:
            del self.leaves[c]
        for parent, (ids, pivots) in list(self.children.items()):
            keep = np.array([int(i) not in empty for i in ids])
            if not keep.all():
                self.children[parent] = (ids[keep], pivots[keep])

    def _write(self, rows: DataFrame) -> None:
        name = f"rows-{uuid.uuid4().hex}"
        out = self._descended(rows).drop("far")
        out.repartitionByRange("cell", "row_id").sortWithinPartitions("cell", "row_id").write.parquet(f"{self.path}/{name}")
        self.parts.append(name)

    def _commit(self) -> None:
        parent = {int(i): (p, pivot) for p, (ids, pivots) in self.children.items() for i, pivot in zip(ids, pivots)}
        cells = [(c, p, pivot.tolist(), None, -1, 0) for c, (p, pivot) in parent.items() if c not in self.leaves]
        cells += [(c, parent[c][0] if c in parent else -1, leaf.pivot.tolist(), float(leaf.radius), leaf.n, leaf.chunks) for c, leaf in self.leaves.items()]
        name = f"tree-{uuid.uuid4().hex}"
        self.spark.createDataFrame(cells, TREE_SCHEMA).coalesce(1).write.parquet(f"{self.path}/{name}")
        manifest = {"parts": self.parts, "tree": name, "scale": [float(v).hex() for v in self.scale], "cell_rows": self.cell_rows, "next_id": self.next_id}
        old = json.loads(self.files.read(f"{self.path}/manifest.json")) if self.files.exists(f"{self.path}/manifest.json") else {"parts": [], "tree": None}
        self.files.replace(f"{self.path}/manifest.json", json.dumps(manifest))
        for gone in {*old["parts"], old["tree"]} - {*self.parts, None}:
            self.files.delete(f"{self.path}/{gone}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex | None:
        """The index at ``path`` as last committed, None if there is none."""
        self = cls(spark, path)
        if not self.files.exists(f"{self.path}/manifest.json"):
            return None
        m = json.loads(self.files.read(f"{self.path}/manifest.json"))
        self.parts, self.cell_rows, self.next_id = m["parts"], m["cell_rows"], m["next_id"]
        self.scale = np.array([float.fromhex(v) for v in m["scale"]])
        below: dict[int, list[tuple[int, list[float]]]] = {}
        for r in spark.read.schema(TREE_SCHEMA).parquet(f"{self.path}/{m['tree']}").collect():  # bounded by BROADCAST_BYTES
            if r["parent"] >= 0:
                below.setdefault(r["parent"], []).append((r["cell"], r["pivot"]))
            if r["n"] >= 0:
                self.leaves[r["cell"]] = Leaf(np.array(r["pivot"]), r["radius"], r["n"], r["chunks"])
        for p, kids in below.items():
            kids.sort()
            self.children[p] = (np.array([c for c, _ in kids]), np.array([v for _, v in kids]))
        return self

    # -- upkeep

    def insert(self, observations: DataFrame) -> None:
        """Add rows: they go down the tree into a part of their own; leaves that are overfull then
        are split, and only their rows move."""
        o = observations.select("row_id", doubles(F.col("x")).alias("x"), F.lit(0).cast("long").alias("cell"))
        if not self.leaves:
            fresh = CellIndex.build(o, self.path, scale=self.scale if len(self.scale) else None, cell_rows=self.cell_rows)
            self.__dict__.update(fresh.__dict__)
            return
        new = self._stats(o)
        if not new:
            return
        self._write(o)
        for c, (n, far) in new.items():
            leaf = self.leaves[c]
            leaf.n, leaf.radius = leaf.n + n, max(leaf.radius, far)
        over = {c for c, leaf in self.leaves.items() if leaf.n > OVERFULL * self.cell_rows and leaf.radius > 0}
        if over:
            held = self.rows(over).select("cell", "row_id", "x")
            before = set(self.leaves)
            self._grow(held, over)
            gone = before - set(self.leaves)
            if gone:
                self._write(held.where(F.col("cell").isin(sorted(gone))))
        self._commit()

    def rebuild(self, scale: Sequence[float]) -> None:
        """Build again with the distances of another scale; until then searches under it are exact
        too, with looser bounds.  The old files go once the new ones are committed."""
        fresh = CellIndex.build(self.rows(), self.path, scale=scale, cell_rows=self.cell_rows)
        self.__dict__.update(fresh.__dict__)

    def rows(self, cells: set[int] | None = None) -> DataFrame:
        """Rows of the leaves ``cells``, of all leaves by default."""
        if not self.parts:
            return self.spark.createDataFrame([], ROW_SCHEMA)
        out = self.spark.read.schema(ROW_SCHEMA).parquet(*[f"{self.path}/{p}" for p in self.parts])
        wanted = sorted(set(self.leaves) if cells is None else cells)
        if cells is not None and len(wanted) <= FILTER_CELLS:
            return out.where(F.col("cell").isin(wanted))
        return out.join(F.broadcast(self.spark.createDataFrame(pd.DataFrame({"cell": wanted}))), "cell", "left_semi")

    def nbytes(self) -> int:
        return self.files.size(self.path)

    # -- search

    def _wanted(self, block: Broadcast, held: Broadcast, reach: Broadcast | None, pool: int, budget: int) -> tuple[set[int], np.ndarray]:
        """The leaves that some query reads, and each query's last one in the order of (distance,
        leaf); with ``reach`` the leaves beyond that one which may hold something within it."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaves, used = held.value, np.zeros(len(held.value.ids), bool)
            step = max(1, CELLS // len(leaves.ids))
            for whole in batches:
                for a in range(0, whole.num_rows, step):
                    at = whole.column(0).slice(a, step).to_numpy(zero_copy_only=False)
                    d = _near(block.value[at], leaves.pivots)
                    if reach is not None:
                        far, last, within = (part[at, None] for part in reach.value)
                        used |= leaves.reaches(d, np.arange(len(leaves.ids)), far, last, within).any(axis=0)
                        continue
                    order = d.argsort(axis=1, kind="stable")
                    size = leaves.n[order]
                    count = np.maximum((np.cumsum(size, axis=1) - size < pool).sum(axis=1), min(budget, len(leaves.ids)))
                    last = order[np.arange(len(at)), count - 1]
                    far = d[np.arange(len(at)), last]
                    used |= ((d < far[:, None]) | (d == far[:, None]) & (np.arange(len(leaves.ids)) <= last[:, None])).any(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(far), pa.array(last)], names=["q", "far", "last"])
            some = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), -1)), pa.array(np.zeros(len(some))), pa.array(some)], names=["q", "far", "last"])

        n = len(block.value)
        tasks = min(-(-n // 64), 4 * self.spark.sparkContext.defaultParallelism)
        out = self.spark.range(0, n, 1, max(1, tasks)).mapInArrow(route, "q long, far double, last long").toArrow()  # a row a query of a bounded block
        at, far, last = (out.column(c).to_numpy() for c in ("q", "far", "last"))
        cut = np.zeros((2, n))
        cut[0, at[at >= 0]], cut[1, at[at >= 0]] = far[at >= 0], last[at >= 0]
        cells = {int(c) for c in held.value.ids[np.unique(last[at < 0])]}
        self.cells_read += len(cells)
        self.rows_read += sum(self.leaves[c].n for c in cells)
        return cells, cut

    def _visit(self, cells: set[int], block: Broadcast, held: Broadcast, cut: Broadcast, pool: int, s: np.ndarray, further: bool) -> DataFrame:
        """``(q, row_id, d2)``: the ``pool`` best of every task for each query, among the rows of
        the leaves that it reads.  The queries travel to the rows."""
        width = len(self.scale)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaves = held.value
            far, last, *within = cut.value
            top, place, cell, readers = TopK(block.value, pool, *within), {int(c): j for j, c in enumerate(leaves.ids)}, None, None
            for b in batches:
                of = b.column(0).to_numpy(zero_copy_only=False)
                x, ids = matrix(b.column(3), width) / s, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(of, kind="stable")
                starts = np.flatnonzero(np.diff(of[order], prepend=-1))
                for here in np.split(order, starts[1:]):
                    if not len(here):
                        continue
                    if of[here[0]] != cell:
                        cell = of[here[0]]
                        j = place[int(cell)]
                        d = _near(block.value, leaves.pivots[j : j + 1])[:, 0]
                        readers = np.flatnonzero(leaves.reaches(d, j, far, last, *within) if further else (d < far) | (d == far) & (j <= last))
                    if len(readers):
                        top.add(x[here], ids[here], readers)
            at, ids, d2 = top.rows()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids), pa.array(d2)], names=["q", "row_id", "d2"])

        return self.rows(cells).select("cell", "chunk", "row_id", "x").mapInArrow(visit, "q long, row_id long, d2 double")

    def knn(self, queries: DataFrame, k: int, *, scale: Sequence[float] | None = None, exclude_self: bool = False, budget: int | None = None, pending: DataFrame | None = None) -> DataFrame:
        """As :func:`nearfield.operators.knn.knn` over the indexed rows and those of ``pending``
        (rows that are not indexed yet): ``(query_id, rank, row_id, d2)``, exact unless ``budget``
        names how many leaves a query may read."""
        if k < 0:
            raise ValueError(f"k must be >= 0, got {k}")
        self.cells_read = self.rows_read = 0
        pool = k + int(exclude_self)
        field = queries.schema["query_id"]
        schema = T.StructType([field, T.StructField("row_id", T.LongType()), T.StructField("d2", T.DoubleType())])
        found = self.spark.createDataFrame([], schema)
        q = queries.select("query_id", doubles(F.col("x")).alias("qx"))
        if k and self.leaves:
            s = np.asarray(scale, float) if scale is not None else np.ones(len(self.scale))
            blocks = max(1, -(-q.count() * (len(s) + 2 * pool + 8) * 8 // BROADCAST_BYTES))
            for b in range(blocks):  # each is a pass over the rows that its queries want
                mine = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else q
                found = found.unionByName(self._search(mine, pool, s, budget))
        if k and pending is not None:
            found = found.unionByName(knn(queries, pending, pool, scale=scale).select("query_id", "row_id", "d2"))
        return _ranked(found, k, exclude_self, "query_id").select("query_id", "rank", "row_id", "d2")

    def _search(self, q: DataFrame, pool: int, s: np.ndarray, budget: int | None) -> DataFrame:
        table = q.toArrow()
        points, pos = np.unique(matrix(table.column("qx"), len(s)) / s, axis=0, return_inverse=True)  # equal queries are searched once
        names = pd.DataFrame({"pos": pos.ravel(), "query_id": table.column("query_id").combine_chunks().to_pandas()})
        names = self.spark.createDataFrame(names, T.StructType([T.StructField("pos", T.LongType()), q.schema["query_id"]]))
        ids = np.array(sorted(self.leaves))
        at = [self.leaves[int(c)] for c in ids]
        share = self.spark.sparkContext.broadcast
        held = share(Leaves(ids, np.array([a.pivot for a in at]) * self.scale / s, np.array([a.radius for a in at]) * float((self.scale / s).max(initial=0.0)), np.array([a.n for a in at])))
        block = share(points)
        cells, cut = self._wanted(block, held, None, pool, budget or 0)
        near = self._visit(cells, block, held, share((*cut,)), pool, s, False)
        if budget is None:
            near = written(near, "near")
            best = _ranked(near, pool, False, "q").groupBy("q").agg(F.max("d2").alias("kth"), F.max("rank").alias("found")).where(F.col("found") >= pool).toArrow()
            within = np.full(len(points), np.inf)
            within[best.column("q").to_numpy()] = best.column("kth").to_numpy()
            cut = share((*cut, within))
            cells, _ = self._wanted(block, held, cut, pool, 0)
            near = near.unionByName(self._visit(cells, block, held, cut, pool, s, True))
        return near.join(F.broadcast(names), F.col("q") == F.col("pos")).select("query_id", "row_id", "d2")
