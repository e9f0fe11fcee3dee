"""Scalar functions that run on the driver or inside Arrow batches."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

EPS_VAR = 1e-9


def ndtri(p: float) -> float:
    """The normal quantile: -inf at 0, inf at 1, NaN outside [0, 1]."""
    if not 0 <= p <= 1:
        return math.nan
    if p in (0, 1):
        return -math.inf if p == 0 else math.inf
    return NormalDist().inv_cdf(p)


def erf_approx(x: float) -> float:
    """Abramowitz and Stegun 7.1.26."""
    # fixed values of the published approximation
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    t = 1 / (1 + p * abs(x))
    poly = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5))))
    return math.copysign(1 - poly * math.exp(-x * x), x)


def z_crit(level: float) -> float:
    """The two-sided normal critical value of a confidence level, by bisection."""
    if not 0 < level < 1:
        raise ValueError(f"level must be in (0, 1), got {level}")
    want, low, high = 0.5 + level / 2, 0.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * (1 + erf_approx(mid / math.sqrt(2))) < want else (low, mid)
    return (low + high) / 2


def finite(values: object, name: str) -> np.ndarray:
    a = np.asarray(values, dtype=float)
    if not np.isfinite(a).all():
        raise ValueError(f"NaN or Inf not allowed in {name}")
    return a


def standardize_y(y: object) -> tuple[float, float]:
    """(median, population standard deviation); the deviation is 1 where it is 0 or not finite,
    and an empty input gives (NaN, 1)."""
    a = np.asarray(y, dtype=float).ravel()
    if not len(a):
        return math.nan, 1.0
    sd = float(a.std())
    return float(np.median(a)), sd if math.isfinite(sd) and sd > 0 else 1.0


def check_y_bounds(bounds: object, num_metrics: int) -> np.ndarray:
    """Open intervals per metric, as (m, 2); None is no bounds."""
    b = np.asarray([[-np.inf, np.inf]] * num_metrics if bounds is None else bounds, dtype=float)
    if b.shape != (num_metrics, 2):
        raise ValueError(f"y_bounds must have shape ({num_metrics}, 2), got {b.shape}")
    if np.isnan(b).any() or (b[:, 0] >= b[:, 1]).any() or (b[:, 0] == np.inf).any() or (b[:, 1] == -np.inf).any():
        raise ValueError("y_bounds need lo < hi, with -inf and inf for open sides")
    return b


def identity_bounds(bounds: np.ndarray) -> bool:
    return bool(np.isinf(bounds).all())
