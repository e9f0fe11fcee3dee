"""The model: observations in a store, posteriors as arrays.

Every call searches the store once, whole or through the index of cells; only results of the size of
the queries come back.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.numeric import finite, identity_bounds
from nearfield.operators import posterior as post
from nearfield.operators.knn import knn
from nearfield.plans.calibrator import ENNNormal, unwarp_array, warp_array
from nearfield.plans.config import ENNMetricLearning, validate_tied_dims
from nearfield.plans.fitter import ENNParams, PosteriorFlags
from nearfield.plans.metric import AutoMetric
from nearfield.plans.settings import Settings
from nearfield.sources.cells import CellIndex
from nearfield.sources.store import ObservationStore, check_rows


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class EpistemicNearestNeighbors:
    """Nearest-neighbour regression with model and noise standard errors.

    ``train_x`` is (n, d), ``train_y`` (n, m), ``train_yvar`` like ``train_y``.  ``y_bounds`` are
    open intervals (m, 2) that predictions stay inside.  ``weighting`` learns input weights as
    rows arrive.  The store lies in ``work_dir``; ``open`` takes it up again.
    """

    def __init__(self, train_x, train_y, train_yvar=None, tied_dims=None, *, work_dir, weighting: bool = False, y_bounds=None, spark: SparkSession | None = None) -> None:
        carried = tuple(getattr(train_x, "tied_dims", ())) if weighting else ()
        if tied_dims is not None and carried and tuple(map(tuple, tied_dims)) != carried:
            raise ValueError("tied_dims differ from those of the rows")
        x, y, yvar = check_rows(train_x, train_y, train_yvar)
        tied = validate_tied_dims(tied_dims if tied_dims is not None else carried, x.shape[1])
        if tied and not weighting:
            raise ValueError("tied_dims need weighting=True")
        self.spark = spark or session()
        self.store = ObservationStore.create(self.spark, os.fspath(work_dir), x.shape[1], y.shape[1], has_yvar=yvar is not None, y_bounds=y_bounds, tied_dims=tied, weighting=weighting)
        try:
            self._start()
            self.add(x, y, yvar)
            self.store.commit()
        except BaseException:
            self.store.close()
            raise

    def _start(self) -> None:
        self._auto = AutoMetric(self.num_dim, self.num_outputs, self.tied_dims, **self.store.identity.get("policy", {})) if self.weighting else None
        self._scales: np.ndarray | None = None
        self.settings = Settings.load(self.spark)
        self._cells = CellIndex.open(self.spark, self.store.index_path)

    @classmethod
    def open(cls, work_dir, spark: SparkSession | None = None) -> EpistemicNearestNeighbors:
        self = cls.__new__(cls)
        self.spark = spark or session()
        self.store = ObservationStore.open(self.spark, os.fspath(work_dir))
        self._start()
        if self._auto is not None and len(self):
            self._refill()
            state = self.store.identity.get("metric")
            if state:
                self._auto.weights, self._auto.built = (np.array([float.fromhex(v) for v in state[k]]) for k in ("weights", "built"))
                self._auto.next_refit, self._auto.heldout_gain = state["next_refit"], state["gain"]
                self._auto.num_refits, self._auto.num_rescales, self._auto.num_rebuilds = state["counts"]
        return self

    def _refill(self) -> None:
        """All rows through the reservoir once more, in order."""
        for row in self.store.rows().select("row_id", "x", "y_natural").orderBy("row_id").toLocalIterator():
            self._auto.rows.add([row["x"]], [row["y_natural"]])

    def configure_metric(self, *, tied_dims=None, **policy: object) -> None:
        """Take another policy (``rebuild_drift``, ``refit_growth``, ``reservoir_capacity``,
        ``seed``, ``tied_dims``) for the weights; learnt weights stay until the next refit."""
        if self._auto is None:
            raise ValueError("a model without weighting has no policy")
        unknown = sorted(set(policy) - {"rebuild_drift", "refit_growth", "reservoir_capacity", "seed"})
        if unknown:
            raise ValueError(f"a policy has no {', '.join(unknown)}")
        policy = self.store.identity.get("policy", {}) | policy
        tied = self.tied_dims if tied_dims is None else validate_tied_dims(tied_dims, self.num_dim)
        old, self._auto = self._auto, AutoMetric(self.num_dim, self.num_outputs, tied, **policy)
        for name in ("weights", "built", "next_refit", "heldout_gain", "num_refits", "num_rescales", "num_rebuilds"):
            setattr(self._auto, name, getattr(old, name))
        if len(self):
            self._refill()
        self.store.identity |= {"policy": policy, "tied_dims": [list(g) for g in tied]}
        self.keep_metric()

    def keep_metric(self) -> None:
        """Commit the learnt weights with the rows."""
        a = self._auto
        hexes = lambda w: [float(v).hex() for v in w]
        self.store.identity["metric"] = {"weights": hexes(a.weights), "built": hexes(a.built), "next_refit": a.next_refit, "gain": a.heldout_gain, "counts": [a.num_refits, a.num_rescales, a.num_rebuilds]}
        if self.store.identity["committed"]:
            self.store.commit()

    def close(self) -> None:
        self.store.close()

    def __enter__(self) -> EpistemicNearestNeighbors:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # -- rows

    def add(self, train_x, train_y, train_yvar=None) -> None:
        x, y, yvar = check_rows(train_x, train_y, train_yvar, self.store.identity)
        if not len(x):
            return
        self.store.append_arrays(x, y, yvar)
        self._scales = None
        if self._auto is not None:
            self._auto.observe(x, y)
            self.keep_metric()
        if len(self) - self.num_indexed >= self.settings.index_min_rows and self.num_dim <= self.settings.index_max_dim:
            self.ensure_index_sync()

    def __len__(self) -> int:
        return self.store.identity["num_obs"]

    num_dim = property(lambda self: self.store.identity["num_dim"])
    num_outputs = property(lambda self: self.store.identity["num_metrics"])
    weighting = property(lambda self: self.store.identity["weighting"])
    tied_dims = property(lambda self: tuple(map(tuple, self.store.identity["tied_dims"])))
    y_bounds = property(lambda self: self.store.y_bounds)
    metric = property(lambda self: self._auto)

    @property
    def metric_learning(self) -> ENNMetricLearning:
        return ENNMetricLearning.AUTO if self.weighting else ENNMetricLearning.NONE

    @property
    def x_scale_row(self) -> np.ndarray:
        return np.ones(self.num_dim) if self._auto is None else self._auto.x_scale

    @property
    def y_scale_row(self) -> np.ndarray:
        """Population deviations of (warped) y."""
        if self._scales is None:
            out = np.ones(self.num_outputs)
            for r in self.store.statistics().collect():
                out[r["metric"]] = r["y_scale"]
            self._scales = out
        return self._scales

    def train_rows_at(self, indices) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        rows = self.store.gather(indices).collect()
        x = np.array([r["x"] for r in rows]).reshape(-1, self.num_dim)
        y = np.array([r["y_natural"] for r in rows]).reshape(-1, self.num_outputs)
        has = self.store.identity["has_yvar"]
        v = np.array([r["yvar"] for r in rows]).reshape(-1, self.num_outputs) if has else None
        if v is not None and not identity_bounds(self.y_bounds):
            _, slope = unwarp_array(warp_array(y, self.y_bounds), self.y_bounds)
            v = v * slope**2
        return x, y, v

    @property
    def num_indexed(self) -> int:
        """Rows that the index holds: always those with the least row ids."""
        return 0 if self._cells is None else self._cells.n

    def ensure_index_sync(self) -> None:
        """Bring all rows into the index.  Rows are visible to searches before that too.  An index
        whose scale the learnt weights have left behind is built again."""
        if not len(self):
            return
        scale = self.x_scale_row
        if self._cells is None:
            self._cells = CellIndex.build(self.store.rows(), self.store.index_path, scale=scale, cell_rows=self.settings.index_cell_rows)
            return
        if self.num_indexed < len(self):
            self._cells.insert(self.store.rows().where(F.col("row_id") >= self.num_indexed))
        ratio = self._cells.scale / scale
        if ratio.max() > self.settings.index_stretch * ratio.min():
            self._cells.rebuild(scale)

    def schedule_background_flush(self) -> None:
        """Merge the store's batches when there are many."""
        if self.store.identity["batches"] >= 64:
            self.store.compact(int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def persist_index_to_disk(self) -> None:
        """The index is on disk as soon as it is built; this takes in the rows that it lacks."""
        self.ensure_index_sync()

    def index_memory_bytes(self) -> int:
        """Bytes of the index's files; of the rows where there is no index."""
        return self.store.nbytes() if self._cells is None else self._cells.nbytes()

    # -- searches

    def observations(self) -> DataFrame:
        return self.store.rows() if self.store.identity["has_yvar"] else self.store.rows().drop("yvar")

    @property
    def _strategy(self) -> str | Callable[..., DataFrame]:
        """One pass over all rows, or the index and one pass over the rows that it lacks."""
        cells = self._cells
        if cells is None or not cells.n:
            return "auto"
        pending = self.store.rows().where(F.col("row_id") >= cells.n) if cells.n < len(self) else None
        return lambda q, k, scale, exclude: cells.knn(q, k, scale=scale, exclude_self=exclude, budget=self.settings.index_budget, pending=pending)

    def _queries(self, x) -> tuple[DataFrame, np.ndarray]:
        x = finite(x, "x")
        if x.ndim != 2 or x.shape[1] != self.num_dim:
            raise ValueError(f"x must have shape (n, {self.num_dim}), got {x.shape}")
        rows = [(k, r) for k, r in enumerate(x.tolist())]
        return self.spark.createDataFrame(rows, "query_id long, x array<double>"), x

    def neighbors(self, x, k: int, *, exclude_nearest: bool = False) -> np.ndarray:
        """Row ids of the k nearest, nearest first; -1 where a query has fewer than the others."""
        if k < 0:
            raise ValueError(f"k must be >= 0, got {k}")
        q, x = self._queries(x)
        if exclude_nearest and len(self) < 2:
            raise ValueError("exclude_nearest needs at least 2 rows")
        if not k or not len(self) or not len(x):
            return np.zeros((len(x), 0), np.int64)
        rows = knn(q, self.store.rows(), k, scale=self.x_scale_row, exclude_self=exclude_nearest, strategy=self._strategy).collect()
        return self._index(rows, len(x))

    def neighbor_distances_and_indices(self, x, k: int, *, exclude_nearest: bool = False, pad_with_last: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, row ids), both (queries, k); missing places hold inf, and the last
        id there is (or -1)."""
        q, x = self._queries(x)
        d2, ids = np.full((len(x), k), np.inf), np.full((len(x), k), -1, np.int64)
        if k and len(self) and len(x):
            for r in knn(q, self.store.rows(), k, scale=self.x_scale_row, exclude_self=exclude_nearest, strategy=self._strategy).collect():
                d2[r["query_id"], r["rank"] - 1], ids[r["query_id"], r["rank"] - 1] = r["d2"], r["row_id"]
        if pad_with_last:
            for row in ids:
                found = row[row >= 0]
                row[row < 0] = found[-1] if len(found) else -1
        return d2, ids

    @staticmethod
    def _index(rows: list, n: int) -> np.ndarray:
        out = np.full((n, max((r["rank"] for r in rows), default=0)), -1, np.int64)
        for r in rows:
            out[r["query_id"], r["rank"] - 1] = r["row_id"]
        return out

    def _normal(self, rows: list, lead: tuple[int, ...], natural: bool) -> ENNNormal:
        shape = (*lead, self.num_outputs)
        mu, se, epi, ale = np.zeros(shape), np.ones(shape), np.ones(shape), np.zeros(shape)
        for r in rows:
            at = ((r["param_id"],) if len(lead) == 2 else ()) + (r["query_id"], r["metric"])
            mu[at], se[at], epi[at], ale[at] = r["mu"], r["se"], r["se_epi"], r["se_ale"]
        bounds = self.y_bounds
        if natural and not identity_bounds(bounds):
            mu, slope = unwarp_array(mu, bounds)
            se, epi, ale = se * np.abs(slope), epi * np.abs(slope), ale * np.abs(slope)
            return ENNNormal(mu, se, epi, ale, None, bounds)
        return ENNNormal(mu, se, epi, ale)

    def _check(self, flags: PosteriorFlags | None) -> PosteriorFlags:
        flags = flags or PosteriorFlags()
        if flags.exclude_nearest and 0 < len(self) < 2:
            raise ValueError("exclude_nearest=True needs at least 2 rows")
        return flags

    @contextmanager
    def _near(self, q: DataFrame, observations: DataFrame, k: int, flags: PosteriorFlags, strategy, strict: bool):
        """The neighbour rows of one search, kept while they are in use."""
        held = post.neighbours(q, observations, k, flags.exclude_nearest, self.x_scale_row, strategy).persist()
        try:
            yield post.fewest_for_all(held) if strict else held
        finally:
            held.unpersist()

    def _ids(self, near: DataFrame, n: int) -> np.ndarray:
        return self._index(near.select("query_id", "rank", "row_id").collect(), n)

    def posterior(self, x, *, params: ENNParams, flags: PosteriorFlags | None = None, natural: bool = True, strict_batch_k: bool = False) -> ENNNormal:
        """Means and standard errors; with ``strict_batch_k`` all queries use as many neighbours as
        the one that has the fewest."""
        return self._posterior(x, self.observations(), len(self), params, flags, natural, self._strategy, strict_batch_k)

    def _posterior(self, x, observations: DataFrame, n: int, params: ENNParams, flags, natural: bool, strategy, strict: bool = False) -> ENNNormal:
        flags = self._check(flags)
        q, x = self._queries(x)
        if not n or not len(x):
            out = self._normal([], (len(x),), False)
            out.idx = np.zeros((len(x), 0), np.int64)
            return out
        with self._near(q, observations, params.k_num_neighbors, flags, strategy, strict) as near:
            return self._of(near, observations, len(x), params, flags, natural)

    def _of(self, near: DataFrame, observations: DataFrame, n: int, params: ENNParams, flags: PosteriorFlags, natural: bool) -> ENNNormal:
        weighted = post._weighted(near, post.y_scales(observations), F.lit(params.epistemic_variance_scale), F.lit(params.aleatoric_variance_scale), ["query_id"])
        out = self._normal(post._moments(weighted, ["query_id"], flags.observation_noise).collect(), (n,), natural)
        out.idx = self._ids(near, n)
        if params.calibrator is not None and natural:
            out = params.calibrator.apply(out, hypot=False)
        return out

    def batch_posterior(self, x, *, paramss: Sequence[ENNParams], flags: PosteriorFlags | None = None, natural: bool = True, strict_batch_k: bool = False) -> ENNNormal:
        if not paramss:
            raise ValueError("paramss must not be empty")
        flags = self._check(flags)
        q, x = self._queries(x)
        lead = (len(paramss), len(x))
        if not len(self) or not len(x):
            return self._normal([], lead, False)
        rows = [(i, p.k_num_neighbors, p.epistemic_variance_scale, p.aleatoric_variance_scale) for i, p in enumerate(paramss)]
        params = self.spark.createDataFrame(rows, "param_id int, k int, epi double, ale double")
        ks = {p.k_num_neighbors for p in paramss}
        with self._near(q, self.observations(), max(ks), flags, self._strategy, strict_batch_k) as near:
            found = post.batch_posterior(q, self.observations(), params, observation_noise=flags.observation_noise, near=near)
            out = self._normal(found.collect(), lead, natural)
            if len(ks) == 1:
                out.idx = self._ids(near, len(x))
        if natural:
            for i, p in enumerate(paramss):
                if p.calibrator is not None:
                    one = p.calibrator.apply(ENNNormal(out.mu[i], out.se[i], out.se_epi[i], out.se_ale[i], None, out.y_bounds), hypot=False)
                    out.mu[i], out.se[i], out.se_epi[i], out.se_ale[i] = one.mu, one.se, one.se_epi, one.se_ale
        return out

    def _with_whatif(self, x_whatif, y_whatif) -> tuple[DataFrame, int]:
        x, y, _ = check_rows(x_whatif, y_whatif, None)
        if len(x) and (x.shape[1] != self.num_dim or y.shape[1] != self.num_outputs):
            raise ValueError("hypothetical rows must have the model's widths")
        if not len(x):
            return self.observations(), len(self)
        rows = [(len(self) + k, a, b) for k, (a, b) in enumerate(zip(x.tolist(), warp_array(y, self.y_bounds).tolist()))]
        extra = self.spark.createDataFrame(rows, "row_id long, x array<double>, y array<double>")
        return post.joined_with_whatif(self.observations(), extra), len(self) + len(x)

    def conditional_posterior(self, x_whatif, y_whatif, x, *, params: ENNParams, flags: PosteriorFlags | None = None) -> ENNNormal:
        observations, n = self._with_whatif(x_whatif, y_whatif)
        return self._posterior(x, observations, n, params, flags, True, "auto")

    # -- draws

    def posterior_function_draw(self, x, *, params: ENNParams, function_seeds, flags: PosteriorFlags | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(draws (queries, metrics, seeds), row ids)."""
        return self._draws(x, self.observations(), len(self), params, function_seeds, flags, self._strategy)

    def conditional_posterior_function_draw(self, x_whatif, y_whatif, x, *, params: ENNParams, function_seeds, flags: PosteriorFlags | None = None) -> tuple[np.ndarray, np.ndarray]:
        observations, n = self._with_whatif(x_whatif, y_whatif)
        return self._draws(x, observations, n, params, function_seeds, flags, "auto")

    def _draws(self, x, observations: DataFrame, n: int, params: ENNParams, function_seeds, flags, strategy) -> tuple[np.ndarray, np.ndarray]:
        flags = self._check(flags)
        seeds = [int(s) for s in np.asarray(function_seeds).ravel()]
        if not seeds:
            raise ValueError("function_seeds must not be empty")
        q, x = self._queries(x)
        out = np.zeros((len(x), self.num_outputs, len(seeds)))
        if not n or not len(x):
            return out, np.zeros((len(x), 0), np.int64)
        distinct = sorted(set(seeds))
        place = {s: [i for i, t in enumerate(seeds) if t == s] for s in distinct}
        with self._near(q, observations, params.k_num_neighbors, flags, strategy, False) as near:
            found = post.function_draws(q, observations, params.k_num_neighbors, params.epistemic_variance_scale, params.aleatoric_variance_scale, distinct, observation_noise=flags.observation_noise, near=near)
            for r in found.collect():
                out[r["query_id"], r["metric"], place[r["seed"]]] = r["value"]
            bounds = self.y_bounds
            if not identity_bounds(bounds):
                out = np.moveaxis(unwarp_array(np.moveaxis(out, -1, 0), bounds)[0], 0, -1)
            if params.calibrator is not None:
                plain = self._of(near, observations, len(x), replace(params, calibrator=None), flags, True)
                out = params.calibrator.map_draws(out, plain.mu, plain.y_bounds, plain.se)
            return out, self._ids(near, len(x))
