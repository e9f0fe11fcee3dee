"""Dependence statistics, fronts and reservoirs over arrays on the driver (bounded inputs: a
reservoir of rows, one round's candidates).  The DataFrame forms are in ``operators``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from nearfield.plans.config import validate_tied_dims

MIN_VAR, DEPENDENCE_Z, FLOOR, MIN_ROWS = 1e-12, 3.0, 1e-6, 100
# fixed values: the grids of the leave-one-out likelihood
SCALE_GRID = tuple(10.0 ** (-3 + 0.5 * i) for i in range(13))
NOISE_GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)


def _rows(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    if x.ndim != 2:
        raise ValueError(f"x must be 2D, got shape {x.shape}")
    if x.shape[1] == 0:
        raise ValueError("x must have at least 1 dimension, got 0")
    return x


def _y2(y) -> np.ndarray:
    y = np.asarray(y, dtype=float)
    return y.reshape(-1, 1) if y.ndim == 1 else y


def calculate_sobol_indices(x, y) -> np.ndarray:
    x, y = _rows(x), np.asarray(y, dtype=float)
    if y.ndim not in (1, 2) or (y.ndim == 2 and y.shape[1] != 1) or len(y) != len(x):
        raise ValueError(f"y shape {y.shape} incompatible with x rows {len(x)}")
    y, n = y.ravel(), len(x)
    var = y.var() if n else 0.0
    if n < 9 or not var > 0 or not math.isfinite(var):
        return np.ones(x.shape[1])
    bins = 10 if n >= 30 else 3
    out = np.zeros(x.shape[1])
    for j, column in enumerate(x.T):
        if column.var() > MIN_VAR:
            cell = np.argsort(np.argsort(column, kind="stable"), kind="stable") * bins // n
            count = np.bincount(cell, minlength=bins)
            mean = np.bincount(cell, y, bins) / np.maximum(count, 1)
            out[j] = (count / n * (mean - y.mean()) ** 2).sum() / var
    return out


def _between(cell: np.ndarray, b: int, y: np.ndarray) -> float:
    n, c = len(y), y - y.mean()
    total = float(c @ c)
    if n < 2 * b or total <= 0:
        return 0.0
    count, sums = np.bincount(cell, minlength=b), np.bincount(cell, c, b)
    between = float((sums[count > 0] ** 2 / count[count > 0]).sum())
    within = (total - between) / (n - b)
    return max(between - (b - 1) * within, 0.0) / total


def sobol_index(x, y, num_bins: int | None = None) -> np.ndarray:
    x, y = _rows(x), np.asarray(y, dtype=float).reshape(-1)
    n = len(x)
    b = num_bins or max(2, math.isqrt(n))
    if n < 2 * b:
        return np.zeros(x.shape[1])
    return np.array([_between(np.argsort(np.argsort(c, kind="stable"), kind="stable") * b // n, b, y) for c in x.T])


def _cells(x: np.ndarray) -> tuple[np.ndarray, int]:
    _, cell = np.unique(np.ascontiguousarray(x).view(np.int64), axis=0, return_inverse=True)
    return cell.ravel(), int(cell.max()) + 1 if len(cell) else 0


def group_sobol_index(x_group, y) -> float:
    cell, b = _cells(_rows(x_group))
    return 0.0 if b < 2 else _between(cell, b, np.asarray(y, dtype=float).reshape(-1))


def null_sd(n: int, num_cells: int | None = None) -> float:
    if n < 3:
        return math.inf
    return math.sqrt(2.0 * ((num_cells or max(2, math.isqrt(n))) - 1)) / n


def dependence_weights(x, y, floor: float | None = None, tied: Sequence[Sequence[int]] = ()) -> np.ndarray:
    carried = tuple(getattr(x, "tied_dims", ()))
    if tied and carried and tuple(map(tuple, tied)) != carried:
        raise ValueError("the tied groups given differ from those of the rows")
    x, y = _rows(x), _y2(y)
    n, d = x.shape
    groups = validate_tied_dims(tied or carried, d)
    grouped = {j for g in groups for j in g}
    mean = np.mean([sobol_index(x, c) for c in y.T], axis=0)
    units = [[j] for j in range(d) if j not in grouped] + [list(g) for g in groups]
    s = []
    for u in units:
        if len(u) == 1 and u[0] not in grouped:
            s.append(mean[u[0]] if mean[u[0]] > DEPENDENCE_Z * null_sd(n) else 0.0)
        else:
            v = float(np.mean([group_sobol_index(x[:, u], c) for c in y.T]))
            s.append(v if v > DEPENDENCE_Z * null_sd(n, _cells(x[:, u])[1]) else 0.0)
    s = np.array(s)
    s = np.maximum(s, (FLOOR if floor is None else floor) * s.max()) if s.max() > 0 else np.ones(len(s))
    share = len(s) * s / s.sum()
    var = np.where(x.var(axis=0) > MIN_VAR, x.var(axis=0), 1.0)
    out = np.zeros(d)
    for u, v in zip(units, share):
        out[u] = v / (1.0 if u[0] in grouped else var[u])
    return out


def loo_loglik(x, y, a, k: int) -> float:
    """Best mean leave-one-out log likelihood over a grid of scales and noises, of z-scored rows
    with input weights ``a``, averaged over outputs."""
    x, y = _rows(x), _y2(y)
    n = len(x)
    k = min(k, n - 1)
    var = np.where(x.var(axis=0) > MIN_VAR, x.var(axis=0), 1.0)
    z = (x - x.mean(axis=0)) / np.sqrt(var)
    w = np.asarray(a, float) * var
    row = (w * z * z).sum(axis=1)
    d2 = row[:, None] + row[None] - 2.0 * ((w * z) @ z.T)
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, axis=1, kind="stable")[:, :k]
    d2 = np.take_along_axis(d2, near, 1)
    yv = np.where(y.var(axis=0) > MIN_VAR, y.var(axis=0), 1.0)
    yz = (y - y.mean(axis=0)) / np.sqrt(yv)
    best = np.full(y.shape[1], -np.inf)
    for scale in SCALE_GRID:
        for noise in NOISE_GRID:
            weight = 1.0 / (1e-9 + np.maximum(d2 * scale, 0) + noise)
            total = weight.sum(axis=1)
            v = (1 / total + noise)[:, None]
            err = yz - np.einsum("nk,nkm->nm", weight, yz[near]) / total[:, None]
            best = np.maximum(best, (-0.5 * np.log(2 * np.pi * v) - 0.5 * err * err / v).mean(axis=0))
    return float(best.mean())


def auto_weights(x, y, k: int, tied: Sequence[Sequence[int]] = ()) -> tuple[np.ndarray, float]:
    """(weights, gain in held-out likelihood over equal weights); too few rows gain nothing."""
    plain = _rows(x)
    if len(plain) < MIN_ROWS:
        return np.ones(plain.shape[1]), -math.inf
    w = dependence_weights(x, y, tied=tied)
    return w, loo_loglik(plain, y, w, k) - loo_loglik(plain, y, np.ones(plain.shape[1]), k)


def side_lengths(weights: np.ndarray) -> np.ndarray:
    """Sides of a region of unit volume, longer where an input matters less."""
    s = 1.0 / np.asarray(weights, float)
    s = s / s.mean()
    return s / np.exp(np.log(s).mean())


def pareto_front_2d_maximize(a, b, idx=None) -> np.ndarray:
    """Indices of the front, by a then b descending; equal points are all on it."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    if a.shape != b.shape or a.ndim != 1:
        raise ValueError(f"a and b must have one shape, got {a.shape} and {b.shape}")
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise ValueError("a and b must be finite")
    idx = np.arange(len(a)) if idx is None else np.asarray(idx, np.int64)
    if len(idx) and (idx.min() < 0 or idx.max() >= len(a)):
        raise ValueError("idx is out of range")
    order = idx[np.lexsort((-b[idx], -a[idx]))]
    best = np.maximum.accumulate(np.r_[-np.inf, b[order]])[:-1] if len(order) else np.zeros(0)
    kept = b[order] > best
    front = {(a[i], b[i]) for i in order[kept]}
    return np.array([i for i in order if (a[i], b[i]) in front], np.int64)


def arms_from_pareto_fronts(x_cand, mu, se, num_arms: int, seed: int) -> np.ndarray:
    """Whole fronts of (mu, se) while they fit, a seeded choice from the last, best mu first."""
    mu, se = np.asarray(mu, dtype=float), np.asarray(se, dtype=float)
    if mu.shape != se.shape:
        raise ValueError(f"shape mismatch: mu {mu.shape}, se {se.shape}")
    rest, keep = np.arange(len(mu)), []
    rng = np.random.Generator(np.random.PCG64(seed))
    while len(rest) and len(keep) < num_arms:
        front = pareto_front_2d_maximize(mu, se, rest)
        room = num_arms - len(keep)
        keep += (front if len(front) <= room else rng.permutation(front)[:room]).tolist()
        rest = rest[~np.isin(rest, front)]
    keep = np.array(keep, np.int64)
    return keep[np.argsort(-mu[keep], kind="stable")]


def hypervolume_2d_max(y, ref_point) -> float:
    y, ref = np.asarray(y, dtype=float), np.asarray(ref_point, dtype=float)
    if ref.shape != (2,):
        raise ValueError(f"ref_point must have shape (2,), got {ref.shape}")
    if y.size == 0:
        return 0.0
    if y.ndim == 1 and y.shape == (2,):
        y = y[None]
    if y.ndim != 2 or y.shape[1] != 2:
        raise ValueError(f"y must have shape (n, 2), got {y.shape}")
    y = y[(y > ref).all(axis=1)]
    if not len(y):
        return 0.0
    y = y[np.lexsort((-y[:, 1], -y[:, 0]))]
    steps = y[:, 0] - np.r_[y[1:, 0], ref[0]]
    return float((steps * (np.maximum.accumulate(y[:, 1]) - ref[1])).sum())


def argmax_random_tie(values, rng: np.random.Generator) -> int:
    values = np.asarray(values, dtype=float)
    if not len(values):
        return 0
    return int(rng.choice(np.flatnonzero(values == values.max())))


class Reservoir:
    """A uniform sample of the rows of a stream, by the sequential algorithm."""

    def __init__(self, capacity: int, num_dim: int, seed: int, num_outputs: int = 1) -> None:
        if not isinstance(seed, (int, np.integer)):
            raise TypeError("Reservoir seed must be an int")
        if capacity <= 0 or num_dim <= 0 or num_outputs <= 0:
            raise ValueError("capacity and widths must be > 0")
        self.capacity, self.num_seen = int(capacity), 0
        self._shape = (int(num_dim), int(num_outputs))
        self.rng = np.random.Generator(np.random.PCG64(int(seed)))
        self._x: list[np.ndarray] = []
        self._y: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self._x)

    @property
    def x(self) -> np.ndarray:
        return np.array(self._x).reshape(-1, self._shape[0])

    @property
    def y(self) -> np.ndarray:
        return np.array(self._y).reshape(-1, self._shape[1])

    def add(self, x, y) -> None:
        x, y = np.atleast_2d(np.asarray(x, dtype=float)), _y2(y)
        if x.shape[1] != self._shape[0] or y.shape[1] != self._shape[1] or len(x) != len(y):
            raise ValueError(f"rows must have {self._shape[0]} inputs and {self._shape[1]} outputs")
        for a, b in zip(x, y):
            if len(self._x) < self.capacity:
                self._x.append(a.copy()), self._y.append(b.copy())
            else:
                slot = int(self.rng.integers(0, self.num_seen + 1))
                if slot < self.capacity:
                    self._x[slot], self._y[slot] = a.copy(), b.copy()
            self.num_seen += 1

    def resize(self, capacity: int) -> None:
        if capacity < len(self._x):
            raise ValueError("capacity must hold the stored rows")
        self.capacity = capacity


def gaussian_thompson(mu: np.ndarray, sigma: np.ndarray, num_arms: int, rng: np.random.Generator) -> np.ndarray:
    """``num_arms`` candidates, each the best of one independent draw around every mean among those
    not taken yet."""
    mu, sigma = np.asarray(mu, float), np.asarray(sigma, float)
    if not len(mu):
        raise ValueError("there are no candidates")
    taken: list[int] = []
    for _ in range(min(num_arms, len(mu))):
        value = mu + sigma * rng.standard_normal(len(mu))
        value[taken] = -np.inf
        taken.append(int(np.argmax(value)))
    return np.array(taken, np.int64)
