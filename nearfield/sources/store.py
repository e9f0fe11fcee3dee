"""Observation stores: append-only Parquet with an identity file that is written last.

``<dir>/rows/batch=<n>`` holds ``(row_id, x, y, y_natural, yvar)``, row ids running on from batch to
batch.  ``<dir>/identity.json`` names widths, bounds and tied inputs, and how many batches are
committed: a batch that was torn off in mid-write is not read.  All file access goes through
Hadoop's file systems, so a store may lie wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import expr
from nearfield.functions.numeric import check_y_bounds, finite, identity_bounds
from nearfield.operators.posterior import warp_observations, y_scales

SCHEMA = "row_id long, x array<double>, y array<double>, y_natural array<double>, yvar array<double>"


class Files:
    """The few file operations a store needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write beside, then rename over it in one step: a reader, or a crash at any point, sees
        the old text or the new one."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        side = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(side, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(p.toUri(), self.conf).rename(side, p, over)

    def create(self, path: str) -> bool:
        """Make a file that must not exist yet."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        try:
            fs.create(p, False).close()
        except Exception:  # the JVM's FileAlreadyExistsException
            if fs.exists(p):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def check_rows(x: object, y: object, yvar: object | None, like: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Arrays of a batch, checked: two dimensions, equal rows, finite values, variances >= 0."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    yvar = None if yvar is None else np.asarray(yvar, dtype=float)
    if x.ndim != 2 or y.ndim != 2:
        raise ValueError(f"x and y must be 2D, got shapes {x.shape} and {y.shape}")
    if len(x) != len(y):
        raise ValueError(f"x has {len(x)} rows, y has {len(y)}")
    if yvar is not None and yvar.shape != y.shape:
        raise ValueError(f"yvar must have y's shape {y.shape}, got {yvar.shape}")
    if like is not None:
        if x.shape[1] != like["num_dim"] or y.shape[1] != like["num_metrics"]:
            raise ValueError(f"rows must have {like['num_dim']} inputs and {like['num_metrics']} outputs")
        if like["num_obs"] and len(x) and like["has_yvar"] != (yvar is not None):
            raise ValueError("either all rows have yvar or none")
    finite(x, "x"), finite(y, "y")
    if yvar is not None and (finite(yvar, "yvar") < 0).any():
        raise ValueError("yvar must be >= 0")
    return x, y, yvar


class ObservationStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        if not str(path).strip():
            raise ValueError("work_dir must not be empty")
        path = str(path)
        self.spark, self.path, self.files = spark, path if "://" in path or path.startswith("file:") else f"file://{path}", Files(spark)
        self.identity: dict = {}
        self.locked = False

    # -- life

    def lock(self) -> None:
        if not self.files.create(f"{self.path}/store.lock"):
            raise ValueError(f"the store at {self.path} is already open")
        self.locked = True

    def close(self) -> None:
        if self.locked:
            self.files.delete(f"{self.path}/store.lock")
            self.locked = False

    @classmethod
    def create(cls, spark: SparkSession, path: str, num_dim: int, num_metrics: int, *, has_yvar: bool = False, y_bounds: object | None = None, tied_dims: Sequence[Sequence[int]] = (), weighting: bool = False) -> ObservationStore:
        self = cls(spark, path)
        if self.files.exists(f"{self.path}/identity.json") and json.loads(self.files.read(f"{self.path}/identity.json"))["committed"]:
            raise ValueError(f"{self.path} holds a store; open it")
        self.lock()
        for left in ("rows", "index"):  # of a store that never committed
            self.files.delete(f"{self.path}/{left}")
        bounds = check_y_bounds(y_bounds, num_metrics)
        self.identity = {"num_dim": num_dim, "num_metrics": num_metrics, "has_yvar": has_yvar, "weighting": weighting, "tied_dims": [list(map(int, g)) for g in tied_dims], "y_bounds": [[float(v).hex() for v in b] for b in bounds], "batches": 0, "num_obs": 0, "committed": False}
        return self

    def commit(self) -> None:
        self.identity["committed"] = True
        self.files.replace(f"{self.path}/identity.json", json.dumps(self.identity))

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, lock: bool = True) -> ObservationStore:
        self = cls(spark, path)
        if not self.files.exists(f"{self.path}/identity.json"):
            raise ValueError(f"there is no store at {self.path}")
        self.identity = json.loads(self.files.read(f"{self.path}/identity.json"))
        if lock:
            self.lock()
        return self

    def _change(self, **changes: object) -> None:
        """Change the identity and commit it, or leave both as they were."""
        before = dict(self.identity)
        self.identity |= changes
        if self.identity["committed"]:
            try:
                self.commit()
            except BaseException:
                self.identity = before
                raise

    @property
    def folder(self) -> str:
        """Where the rows are: a new folder for every version of them."""
        return f"{self.path}/{self.identity.get('rows', 'rows')}"

    @property
    def index_path(self) -> str:
        """Where an index over the rows lies; it is derived, so it may be deleted at any time."""
        return f"{self.path}/index"

    def clear(self) -> None:
        old = self.folder
        self.files.delete(self.index_path)  # first: no index of old rows may meet new ones
        self._change(batches=0, num_obs=0, rows=f"rows-{uuid.uuid4().hex}")
        self.files.delete(old)

    # -- rows

    @property
    def y_bounds(self) -> np.ndarray:
        return np.array([[float.fromhex(v) for v in b] for b in self.identity["y_bounds"]])

    def rows(self) -> DataFrame:
        """All committed rows: ``(row_id, x, y, y_natural, yvar)``, y on the line if bounded."""
        paths = [f"{self.folder}/batch={k}" for k in range(self.identity["batches"])]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def append(self, rows: DataFrame, **also: object) -> int:
        """Append ``rows(position, x, y[, yvar])``, positions from 0 without gaps, and commit, with
        the entries ``also`` of the identity.  Values are checked where the rows are: a bad one
        fails the job and nothing is committed."""
        i = self.identity
        x, y = expr.doubles(F.col("x")), expr.doubles(F.col("y"))
        fine = lambda a: F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < expr.INF))
        ok = (F.size(x) == i["num_dim"]) & (F.size(y) == i["num_metrics"]) & fine(x) & fine(y)
        v = expr.doubles(F.col("yvar")) if "yvar" in rows.columns else F.lit(None).cast("array<double>")
        if i["has_yvar"]:
            ok = ok & F.coalesce((F.size(v) == i["num_metrics"]) & fine(v) & F.forall(v, lambda a: a >= 0), F.lit(False))
        else:
            ok = ok & v.isNull()
        checked = rows.select((F.col("position") + i["num_obs"]).alias("row_id"), F.when(F.coalesce(ok, F.lit(False)), x).otherwise(F.raise_error(F.lit("a row of wrong width, or NaN or Inf, or a wrong yvar")).cast("array<double>")).alias("x"), y.alias("y"), v.alias("yvar"))
        bounds = self.y_bounds
        out = checked.withColumn("y_natural", F.col("y")) if identity_bounds(bounds) else warp_observations(checked, bounds)
        where = f"{self.folder}/batch={i['batches']}"
        out.select("row_id", "x", "y", "y_natural", "yvar").write.mode("overwrite").parquet(where)
        n = self.spark.read.schema(SCHEMA).parquet(where).count()
        if n:
            also |= {"batches": i["batches"] + 1, "num_obs": i["num_obs"] + n}
        if also:
            self._change(**also)
        return n

    def append_arrays(self, x: object, y: object, yvar: object | None = None) -> int:
        x, y, yvar = check_rows(x, y, yvar, self.identity)
        if not len(x):
            return 0
        rows = [(k, a, b, None if yvar is None else yvar[k].tolist()) for k, (a, b) in enumerate(zip(x.tolist(), y.tolist()))]
        for j, (lo, hi) in enumerate(self.y_bounds.tolist()):
            if not ((y[:, j] > lo) & (y[:, j] < hi)).all():
                raise ValueError(f"y of metric {j} must lie strictly inside ({lo}, {hi})")
        return self.append(self.spark.createDataFrame(rows, "position long, x array<double>, y array<double>, yvar array<double>"))

    def gather(self, row_ids: Sequence[int]) -> DataFrame:
        """``(position, row_id, x, y_natural, yvar)`` for row ids in any order, repeats included."""
        ids = [int(r) for r in row_ids]
        if any(not 0 <= r < self.identity["num_obs"] for r in ids):
            raise ValueError("row index out of range")
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "position long, w_row long")
        return wanted.join(self.rows(), F.col("w_row") == F.col("row_id")).select("position", "row_id", "x", "y_natural", "yvar").orderBy("position")

    def statistics(self) -> DataFrame:
        return y_scales(self.rows())

    def nbytes(self) -> int:
        return self.files.size(self.folder)

    def compact(self, files: int) -> None:
        """Rewrite all batches as one, in ``files`` files: written to a new folder, which the
        identity names from its commit on; only then does the old one go."""
        old, new = self.folder, f"rows-{uuid.uuid4().hex}"
        self.rows().repartitionByRange(files, "row_id").write.parquet(f"{self.path}/{new}/batch=0")
        self._change(rows=new, batches=1)
        self.files.delete(old)
