"""Affine calibration and normal posteriors as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from nearfield.functions.numeric import check_y_bounds, identity_bounds, z_crit


def warp_array(y: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.array(y, float)
    for j, (lo, hi) in enumerate(bounds):
        a, b, v = np.isfinite(lo), np.isfinite(hi), out[..., j]
        if a and b:
            out[..., j] = np.log(v - lo) - np.log(hi - v)
        elif a:
            out[..., j] = np.log(v - lo)
        elif b:
            out[..., j] = -np.log(hi - v)
    return out


def unwarp_array(z: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(natural values, slopes there)."""
    out, slope = np.array(z, float), np.ones_like(z, dtype=float)
    for j, (lo, hi) in enumerate(bounds):
        a, b, v = np.isfinite(lo), np.isfinite(hi), out[..., j].copy()
        if a and b:
            s = 1 / (1 + np.exp(-v))
            out[..., j], slope[..., j] = lo + (hi - lo) * s, (hi - lo) * s * (1 - s)
        elif a:
            out[..., j], slope[..., j] = lo + np.exp(v), np.exp(v)
        elif b:
            out[..., j], slope[..., j] = hi - np.exp(-v), np.exp(-v)
    return out, slope


def project_array(mu: np.ndarray, bounds: np.ndarray | None, se: np.ndarray | None = None) -> np.ndarray:
    out = np.array(mu, float)
    for j, (lo, hi) in enumerate([] if bounds is None else bounds):
        a, b = np.isfinite(lo), np.isfinite(hi)
        if not a and not b:
            continue
        least = max(1e-3, 1e-6 * (hi - lo)) if a and b else 1e-3
        e = np.maximum(least, 0.25 * np.abs(se[..., j])) if se is not None else np.full(out[..., j].shape, least)
        low, high = (lo + e if a else -np.inf), (hi - e if b else np.inf)
        clipped = np.minimum(np.maximum(out[..., j], low), high)
        out[..., j] = np.where(low >= high, (lo + hi) / 2, clipped) if a and b else clipped
    return out


class ENNNormal:
    """Means and standard errors, of shape (queries, metrics) or (params, queries, metrics)."""

    def __init__(self, mu, se, se_epi, se_ale, idx=None, y_bounds=None) -> None:
        self.mu, self.se, self.se_epi, self.se_ale = (np.asarray(a, dtype=float) for a in (mu, se, se_epi, se_ale))
        self.idx = None if idx is None else np.asarray(idx)
        self.y_bounds = None if y_bounds is None else check_y_bounds(y_bounds, self.mu.shape[-1])

    def _line(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Mean and standard error where y is unbounded, or None if it is everywhere."""
        if self.y_bounds is None or identity_bounds(self.y_bounds):
            return None
        z = warp_array(self.mu, self.y_bounds)
        slope = unwarp_array(z, self.y_bounds)[1]
        return z, self.se / np.abs(slope)

    def sample(self, num_samples: int, seed: int, clip: float | None = None) -> np.ndarray:
        """Independent normals, samples along a new last axis; deviates are clipped if asked."""
        eps = np.random.Generator(np.random.PCG64(seed)).standard_normal((*self.mu.shape, num_samples))
        eps = eps if clip is None else np.clip(eps, -clip, clip)
        line = self._line()
        if line is None:
            return self.mu[..., None] + self.se[..., None] * eps
        z = line[0][..., None] + line[1][..., None] * eps
        return np.moveaxis(unwarp_array(np.moveaxis(z, -1, 0), self.y_bounds)[0], 0, -1)

    def confidence_interval(self, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
        z, line = z_crit(level), self._line()
        if line is None:
            return self.mu - z * self.se, self.mu + z * self.se
        return tuple(unwarp_array(line[0] + s * z * line[1], self.y_bounds)[0] for s in (-1, 1))


def _columns(a) -> np.ndarray:
    out = np.asarray(a, dtype=float)
    return out.reshape(-1, 1) if out.ndim == 1 else out


@dataclass
class AffineCalibrator:
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray

    def __post_init__(self) -> None:
        self.a, self.b, self.c = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (self.a, self.b, self.c))
        if not len(self.a) == len(self.b) == len(self.c):
            raise ValueError("a, b and c must have one value for each metric")

    @classmethod
    def identity(cls, num_metrics: int = 1) -> AffineCalibrator:
        return cls(np.zeros(num_metrics), np.ones(num_metrics), np.ones(num_metrics))

    @classmethod
    def fit(cls, mu, y, se=None, *, fit_residual_scale: bool = True) -> AffineCalibrator:
        mu, y = _columns(mu), _columns(y)
        if mu.shape != y.shape:
            raise ValueError(f"mu and y must have one shape, got {mu.shape} and {y.shape}")
        n, out = len(mu), cls.identity(mu.shape[1])
        if n < 2:
            return out
        for j in range(mu.shape[1]):
            m, v = mu[:, j], y[:, j]
            det = n * (m @ m) - m.sum() ** 2
            if abs(det) >= 1e-18 * max(1.0, abs(n * (m @ m))):
                out.b[j] = (n * (m @ v) - m.sum() * v.sum()) / det
                out.a[j] = (v.sum() - out.b[j] * m.sum()) / n
            if se is not None and fit_residual_scale:
                s = _columns(se)[:, j]
                spread = np.sqrt(np.mean(s * s))
                if spread > 0:
                    out.c[j] = np.sqrt(np.mean((v - out.a[j] - out.b[j] * m) ** 2)) / spread
        return out

    def _check(self, m: int) -> None:
        if len(self.a) != m:
            raise ValueError(f"the calibrator is for {len(self.a)} metrics, not {m}")

    def apply(self, normal: ENNNormal, *, hypot: bool = True) -> ENNNormal:
        """Means mapped (and kept inside bounds), errors scaled; the total from its parts, or
        scaled itself."""
        self._check(normal.mu.shape[-1])
        epi, ale = normal.se_epi * self.c, normal.se_ale * self.c
        se = np.hypot(epi, ale) if hypot else normal.se * self.c
        return ENNNormal(project_array(self.a + self.b * normal.mu, normal.y_bounds, se), se, epi, ale, normal.idx, normal.y_bounds)

    def map_mu(self, mu, y_bounds=None, se=None) -> np.ndarray:
        mu = np.asarray(mu, dtype=float)
        self._check(mu.shape[-1])
        return project_array(self.a + self.b * mu, None if y_bounds is None else np.asarray(y_bounds, float), None if se is None else np.asarray(se, float))

    def map_draws(self, draws, mu, y_bounds=None, se=None) -> np.ndarray:
        """a + b mu + c (draw - mu); draws may have samples along a last axis that mu has not."""
        draws, mu = np.asarray(draws, dtype=float), np.asarray(mu, dtype=float)
        self._check(mu.shape[-1])
        centre = self.map_mu(mu, y_bounds, se)
        if draws.ndim == mu.ndim + 1:
            return centre[..., None] + self.c[:, None] * (draws - mu[..., None])
        return centre + self.c * (draws - mu)
