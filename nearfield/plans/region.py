"""Trust regions: one objective, none at all, and several objectives by random scalarisation."""

from __future__ import annotations

import math

import numpy as np
from numpy.random import Generator

from nearfield.plans.config import MorboTRConfig, NoTRConfig, Rescalarize, TRLengthConfig

SUCCESSES, STEP = 3, 1e-3


class Region:
    """A box around the incumbent that doubles after three successes in a row, halves after a
    dimension's worth of failures, and asks for a restart when it has become too small."""

    num_metrics = 1

    def __init__(self, num_dim: int, length: TRLengthConfig = TRLengthConfig()) -> None:
        self.num_dim = num_dim
        self.init, self.low, self.high = length.resolved()
        self.patience: int | None = None
        self.restart()

    def restart(self, rng: Generator | None = None) -> None:
        self.length, self.best, self.successes, self.failures = self.init, -math.inf, 0, 0

    def set_arms(self, arms: int) -> None:
        self.patience = max(1, math.ceil(max(4.0, self.num_dim) / arms))

    def update(self, incumbent: float, scale: float | None = None) -> None:
        if not math.isfinite(self.best):
            self.best = incumbent
            return
        better = incumbent > self.best + STEP * (abs(self.best) if scale is None else scale)
        self.successes, self.failures = (self.successes + 1, 0) if better else (0, self.failures + 1)
        if self.successes >= SUCCESSES:
            self.length, self.successes = min(2 * self.length, self.high), 0
        elif self.failures >= (self.patience or 4):
            self.length, self.failures = self.length / 2, 0
        self.best = max(self.best, incumbent)

    def needs_restart(self) -> bool:
        return self.length < self.low

    def box(self, centre: np.ndarray, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        half = self.length / 2 * (np.ones(self.num_dim) if sides is None else sides)
        return np.clip(centre - half, 0, 1), np.clip(centre + half, 0, 1)

    def state(self) -> dict:
        return {"length": self.length.hex(), "best": self.best.hex(), "successes": self.successes, "failures": self.failures, "patience": self.patience}

    def load(self, s: dict) -> None:
        self.length, self.best = float.fromhex(s["length"]), float.fromhex(s["best"])
        self.successes, self.failures, self.patience = s["successes"], s["failures"], s["patience"]


class WholeBox(Region):
    """The whole cube, never restarted."""

    def restart(self, rng: Generator | None = None) -> None:
        super().restart()
        self.length = 1.0

    def update(self, incumbent: float, scale: float | None = None) -> None:
        self.best = max(self.best, incumbent)

    def needs_restart(self) -> bool:
        return False

    def box(self, centre: np.ndarray, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(self.num_dim), np.ones(self.num_dim)


def scalarized(y: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray, alpha: float, clip: bool = True) -> np.ndarray:
    """Least weighted normalised objective plus alpha times their sum; half where a range is flat."""
    span = np.asarray(high) - low
    z = np.where(span > 0, (y - low) / np.where(span > 0, span, 1), 0.5)
    z = np.clip(z, 0, 1) if clip else z
    t = np.where(span > 0, z, 0.5) * weights
    return t.min(axis=1) + alpha * t.sum(axis=1)


class MorboRegion(Region):
    def __init__(self, num_dim: int, config: MorboTRConfig, rng: Generator) -> None:
        self.num_metrics, self.alpha, self.policy = config.num_metrics, config.alpha, config.rescalarize
        self.weights = np.ones(self.num_metrics) / self.num_metrics
        super().__init__(num_dim, config.length)
        self.resample(rng)

    def restart(self, rng: Generator | None = None) -> None:
        super().restart()
        self.y_low = self.y_high = self.incumbent = None
        self.scores: tuple[float, float, int] = (math.inf, -math.inf, 0)
        if rng is not None and self.policy is Rescalarize.ON_RESTART:
            self.resample(rng)

    def resample(self, rng: Generator) -> None:
        g = np.maximum(-np.log(1 - rng.random(self.num_metrics)), 1e-300)
        self.weights = g / g.sum()

    def see(self, y: np.ndarray) -> None:
        low, high = y.min(axis=0), y.max(axis=0)
        self.y_low = low if self.y_low is None else np.minimum(self.y_low, low)
        self.y_high = high if self.y_high is None else np.maximum(self.y_high, high)

    def score(self, y: np.ndarray, clip: bool = True) -> np.ndarray:
        if self.y_low is None:
            raise ValueError("no observations to scalarize with")
        return scalarized(np.atleast_2d(y), self.y_low, self.y_high, self.weights, self.alpha, clip)

    def score_local(self, y: np.ndarray) -> np.ndarray:
        return scalarized(y, y.min(axis=0), y.max(axis=0), self.weights, self.alpha)

    def update_incumbent(self, y: np.ndarray) -> None:
        """Compare with the old incumbent under today's ranges and weights."""
        if self.incumbent is not None:
            self.best = float(self.score(self.incumbent)[0])
        score = float(self.score(y)[0])
        low, high, n = self.scores
        super().update(score, max(high - low, 1e-6) if n >= 2 else 0.0)
        self.scores = (min(low, score), max(high, score), n + 1)
        self.incumbent = np.array(y, float)

    def state(self) -> dict:
        hexes = lambda a: None if a is None else [float(v).hex() for v in a]
        return super().state() | {"weights": hexes(self.weights), "y_low": hexes(self.y_low), "y_high": hexes(self.y_high), "incumbent": hexes(self.incumbent), "scores": [self.scores[0].hex(), self.scores[1].hex(), self.scores[2]]}

    def load(self, s: dict) -> None:
        super().load(s)
        back = lambda a: None if a is None else np.array([float.fromhex(v) for v in a])
        self.weights, self.y_low, self.y_high, self.incumbent = (back(s[k]) for k in ("weights", "y_low", "y_high", "incumbent"))
        self.scores = (float.fromhex(s["scores"][0]), float.fromhex(s["scores"][1]), s["scores"][2])


def make_region(config: object, num_dim: int, rng: Generator) -> Region:
    if isinstance(config, MorboTRConfig):
        return MorboRegion(num_dim, config, rng)
    if isinstance(config, NoTRConfig):
        return WholeBox(num_dim)
    return Region(num_dim, config.length)
