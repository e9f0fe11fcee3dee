"""Input weights that are learnt as rows arrive."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from nearfield.plans.statistics import MIN_ROWS, Reservoir, auto_weights

# fixed values of the policy
DEFAULT_REBUILD_DRIFT = math.log(2)
DRIFT_WEIGHT_FLOOR = 9.2103
AUTO_MIN_HELDOUT_GAIN = 0.0
AUTO_RESERVOIR_CAPACITY = 1000
AUTO_K = 10
AUTO_REFIT_GROWTH = 1.5
AUTO_RESCALE_TOL = 0.01


def auto_uses_learned_metric(gain: float) -> bool:
    return math.isfinite(gain) and gain > AUTO_MIN_HELDOUT_GAIN


def weight_drift(weights, built) -> float:
    def logs(w) -> np.ndarray:
        v = np.log(np.asarray(w, float))
        return np.maximum(v, v.max() - DRIFT_WEIGHT_FLOOR)

    return float(0.5 * np.abs(logs(weights) - logs(built)).max())


class AutoMetric:
    """Feeds a reservoir and refits the weights whenever the rows seen have grown by half."""

    def __init__(self, num_dim: int, num_outputs: int, tied: Sequence[Sequence[int]] = (), seed: int = 0, *, rebuild_drift: float = DEFAULT_REBUILD_DRIFT, refit_growth: float = AUTO_REFIT_GROWTH, reservoir_capacity: int = AUTO_RESERVOIR_CAPACITY) -> None:
        if refit_growth <= 1:
            raise ValueError("refit_growth must be > 1")
        self.rows = Reservoir(reservoir_capacity, num_dim, seed, num_outputs)
        self.tied = tuple(map(tuple, tied))
        self.weights, self.built = np.ones(num_dim), np.ones(num_dim)
        self.rebuild_drift, self.refit_growth = rebuild_drift, refit_growth
        self.next_refit, self.heldout_gain = MIN_ROWS, None
        self.num_refits = self.num_rescales = self.num_rebuilds = 0

    @property
    def num_seen(self) -> int:
        return self.rows.num_seen

    @property
    def uses_learned(self) -> bool:
        return self.heldout_gain is not None and auto_uses_learned_metric(self.heldout_gain)

    @property
    def x_scale(self) -> np.ndarray:
        return 1 / np.sqrt(self.weights)

    def set_weights(self, weights) -> bool:
        """Take new weights; True if they drifted so far that an index would be rebuilt."""
        w = np.asarray(weights, dtype=float)
        if w.shape != self.weights.shape or not (np.isfinite(w) & (w > 0)).all():
            raise ValueError("weights must be finite, > 0, and match the dimension")
        rebuilt = weight_drift(w, self.built) > self.rebuild_drift
        self.weights = w.copy()
        if rebuilt:
            self.built = w.copy()
            self.num_rebuilds += 1
        else:
            self.num_rescales += 1
        return rebuilt

    def drift(self, weights) -> float:
        return weight_drift(weights, self.built)

    def refit(self) -> bool:
        w, gain = auto_weights(self.rows.x, self.rows.y, AUTO_K, self.tied)
        self.heldout_gain = gain
        self.num_refits += 1
        self.next_refit = max(math.ceil(self.refit_growth * self.num_seen), MIN_ROWS)
        target = w if auto_uses_learned_metric(gain) else np.ones(len(w))
        if 0.5 * np.abs(np.log(target / self.weights)).max() > AUTO_RESCALE_TOL:
            self.set_weights(target)
            return True
        return False

    def observe(self, x, y) -> bool:
        """Rows of one append; the refit is due at most once for each."""
        self.rows.add(x, y)
        return self.refit() if self.num_seen >= self.next_refit else False


class MetricPolicy:
    """The policy of a model that learns its weights: configures it, and reads and sets its state."""

    def __init__(self, model, **policy: object) -> None:
        self._model = model
        model.configure_metric(**{k: v for k, v in policy.items() if v is not None})

    def __getattr__(self, name: str) -> object:
        return getattr(self._model.metric, name)

    def set_weights(self, weights) -> bool:
        rebuilt = self._model.metric.set_weights(weights)
        self._model.keep_metric()
        return rebuilt
