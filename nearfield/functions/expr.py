"""Column builders: distances, maps, warps, projections, test objectives.  JVM-side throughout."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EPS_VAR = 1e-9


def doubles(column: Column) -> Column:
    return column.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def sum_of(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, b: a + b)


def sq_l2(a: Column, b: Column, scale: Sequence[float] | None = None) -> Column:
    """Squared distance of double arrays; with ``scale`` each side is divided by it first."""
    a, b = doubles(a), doubles(b)
    if scale is not None:
        s = literal(scale)
        a, b = F.zip_with(a, s, lambda v, w: v / w), F.zip_with(b, s, lambda v, w: v / w)
    return F.greatest(sum_of(F.zip_with(a, b, lambda u, v: (u - v) * (u - v))), F.lit(0.0))


def to_unit(x: Column, bounds: Sequence[tuple[float, float]]) -> Column:
    """Natural units to the unit cube; a range of no width maps to one half."""
    parts = [F.lit(0.5) if hi == lo else (x[j] - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) for j, (lo, hi) in enumerate(bounds)]
    return F.array(*parts)


def from_unit(u: Column, bounds: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.lit(float(lo)) + u[j] * F.lit(float(hi) - float(lo)) for j, (lo, hi) in enumerate(bounds)])


def _sides(lo: float, hi: float) -> tuple[bool, bool]:
    return math.isfinite(lo), math.isfinite(hi)


def warp(y: Column, lo: float, hi: float) -> Column:
    """The open interval (lo, hi) to the line; infinite sides are no sides."""
    a, b = _sides(lo, hi)
    if a and b:
        t = (y - lo) / (hi - lo)
        return F.ln(t / (1 - t))
    if a:
        return F.ln(y - lo)
    if b:
        return -F.ln(hi - y)
    return y


def unwarp(z: Column, lo: float, hi: float) -> Column:
    a, b = _sides(lo, hi)
    if a and b:
        return lo + (hi - lo) / (1 + F.exp(-z))
    if a:
        return lo + F.exp(z)
    if b:
        return hi - F.exp(-z)
    return z


def unwarp_slope(z: Column, lo: float, hi: float) -> Column:
    """d unwarp / dz."""
    a, b = _sides(lo, hi)
    if a and b:
        s = 1 / (1 + F.exp(-z))
        return (hi - lo) * s * (1 - s)
    if a:
        return F.exp(z)
    if b:
        return F.exp(-z)
    return F.lit(1.0)


def warp_variance(yvar: Column, y: Column, lo: float, hi: float) -> Column:
    """Observation variance on the line: times the squared slope of the warp."""
    a, b = _sides(lo, hi)
    if a and b:
        slope = (hi - lo) / ((y - lo) * (hi - y))
    elif a:
        slope = 1 / (y - lo)
    elif b:
        slope = 1 / (hi - y)
    else:
        return yvar
    return slope * slope * yvar


def inside(y: Column, lo: float, hi: float) -> Column:
    return (y > F.lit(float(lo))) & (y < F.lit(float(hi)))


def project(mu: Column, se: Column, lo: float, hi: float) -> Column:
    """Clamp into [lo + e, hi - e] with e = max(1e-3, 1e-6 * span, |se| / 4); the middle of an
    interval that this empties.  Without a finite span the middle term is absent."""
    a, b = _sides(lo, hi)
    if not a and not b:
        return mu
    least = max(1e-3, 1e-6 * (hi - lo)) if a and b else 1e-3
    e = F.greatest(F.lit(least), 0.25 * F.abs(se))
    if a and b:
        return F.when(lo + e > hi - e, F.lit((lo + hi) / 2)).otherwise(F.least(F.greatest(mu, lo + e), hi - e))
    return F.greatest(mu, lo + e) if a else F.least(mu, hi - e)


def erf(x: Column) -> Column:
    """The rational approximation 7.1.26 of Abramowitz and Stegun."""
    # fixed values of the published approximation
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    t = 1 / (1 + p * F.abs(x))
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def ackley(x: Column, a: float = 20.0, b: float = 0.2, c: float = 2 * math.pi) -> Column:
    """The Ackley function of an array, shifted so that its minimum 0 is at all ones."""
    n = F.size(x)
    squares = sum_of(F.transform(x, lambda v: (v - 1) * (v - 1)))
    waves = sum_of(F.transform(x, lambda v: F.cos(c * (v - 1))))
    return -a * F.exp(-b * F.sqrt(squares / n)) - F.exp(waves / n) + F.lit(a + math.e)


def double_ackley(x: Column, width: int) -> Column:
    """Minus the Ackley function of each half of an array of even width."""
    if width % 2:
        raise ValueError("num_dim must be even")
    return F.array(-ackley(F.slice(x, 1, width // 2)), -ackley(F.slice(x, width // 2 + 1, width // 2)))


def separable_unimodal(x: Column) -> Column:
    """Two objectives, each with one maximum along its own input."""
    # fixed values of the test problem
    peak1, top1, bend1 = 120.0, 500_000.0, 8.0
    peak2, top2, bend2 = 0.91, 12.5, 110.0
    return F.array(top1 - bend1 * (x[0] - peak1) * (x[0] - peak1), top2 - bend2 * (x[1] - peak2) * (x[1] - peak2))


def standardize(value: Column) -> tuple[Column, Column]:
    """Aggregates (median, population deviation); the deviation is 1 where it is 0 or unknown."""
    sd = F.stddev_pop(value)
    return F.median(value), F.when((sd > 0) & (sd < INF), sd).otherwise(F.lit(1.0))
