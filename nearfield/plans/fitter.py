"""Scale search and calibration on a model."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import functions as F

from nearfield.operators import fit
from nearfield.plans.calibrator import AffineCalibrator

CANDIDATES, SAMPLES = 30, 10


@dataclass(frozen=True)
class ENNParams:
    k_num_neighbors: int
    epistemic_variance_scale: float = 1.0
    aleatoric_variance_scale: float = 0.0
    calibrator: AffineCalibrator | None = field(default=None, compare=False, hash=False)

    def __post_init__(self) -> None:
        if self.k_num_neighbors <= 0:
            raise ValueError(f"k_num_neighbors must be > 0, got {self.k_num_neighbors}")
        for name in ("epistemic_variance_scale", "aleatoric_variance_scale"):
            value = getattr(self, name)
            if not np.isfinite(value) or value < 0:
                raise ValueError(f"{name} must be finite and >= 0, got {value}")


@dataclass(frozen=True)
class PosteriorFlags:
    exclude_nearest: bool = False
    observation_noise: bool = False


def candidate_params(n: int, rng: np.random.Generator, infer_aleatoric: bool = True) -> np.ndarray:
    """(epistemic, aleatoric) scales, log-uniform over six decades."""
    out = 10.0 ** rng.uniform(-3, 3, (n, 2))
    if not infer_aleatoric:
        out[:, 1] = 0.0
    return out


def _sampled(model, num: int, seed: int):
    """That many rows of a model, as a DataFrame."""
    from nearfield.functions.random_hash import choose_indices

    rows = choose_indices(len(model), num, seed).tolist()
    return model.store.rows().where(F.col("row_id").isin(rows))


def subsample_loglik(model, x, y, *, paramss, P=10, seed=0, y_std=None) -> list[float]:
    """The leave-one-out log likelihood of P of the rows (x, y) for each parameter value."""
    if not paramss:
        raise ValueError("paramss must not be empty")
    if P <= 0:
        raise ValueError(f"P must be > 0, got {P}")
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if len(x) == 0 or len(model) <= 1:
        return [0.0] * len(paramss)
    if not np.isfinite(y).all():
        return [-np.inf] * len(paramss)
    from nearfield.functions.random_hash import choose_indices

    at = np.arange(len(x)) if len(x) <= P else choose_indices(len(x), P, seed)
    y = y.reshape(len(x), -1)[at]
    post = model.batch_posterior(x[at], paramss=[replace(p, calibrator=None) for p in paramss], flags=PosteriorFlags(True, True), natural=False)
    scale = model.y_scale_row if y_std is None else np.broadcast_to(np.asarray(y_std, float), (y.shape[1],))
    out = []
    for mu, se in zip(post.mu, post.se):
        with np.errstate(divide="ignore", invalid="ignore"):
            u, m, v = se / scale, mu / scale, y / scale
            terms = -0.5 * np.log(2 * np.pi * u * u) - 0.5 * ((v - m) / u) ** 2
        out.append(float(terms.sum()) if np.isfinite(terms).all() and (se > 0).all() else -np.inf)
    return out


class ENNStatefulFitter:
    """Keeps the last answer as a candidate of the next search."""

    def __init__(self, k: int, *, seed: int, infer_aleatoric_variance_scale: bool = True) -> None:
        self._k, self._seed, self._infer = int(k), int(seed), infer_aleatoric_variance_scale
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.last: ENNParams | None = None

    k = property(lambda self: self._k)
    seed = property(lambda self: self._seed)

    def ask(self, model, *, num_fit_candidates=None, num_fit_samples=None, params_warm_start=None, affine_calibrate=False) -> ENNParams:
        from nearfield.api import EpistemicNearestNeighbors

        if not isinstance(model, EpistemicNearestNeighbors):
            raise TypeError(f"a model is needed to fit scales, not a {type(model).__name__}")
        if len(model) < 2:
            return ENNParams(self._k, 1.0, 0.0)
        tries = [ENNParams(self._k, float(e), float(a)) for e, a in candidate_params(num_fit_candidates or CANDIDATES, self.rng, self._infer)]
        warm = params_warm_start or self.last
        if warm is not None:
            tries.append(replace(warm, k_num_neighbors=self._k, calibrator=None))
        sample = _sampled(model, num_fit_samples or SAMPLES, int(self.rng.integers(2**31)))
        rows = [(i, p.k_num_neighbors, p.epistemic_variance_scale, p.aleatoric_variance_scale) for i, p in enumerate(tries)]
        params = model.spark.createDataFrame(rows, "param_id int, k int, epi double, ale double")
        best = fit.best_params(fit.subsample_loglik(sample, model.observations(), params)).first()
        out = tries[best["param_id"]] if best else ENNParams(self._k, 1.0, 0.0)
        self.last = out
        if affine_calibrate:
            out = replace(out, calibrator=fit_affine_calibrator(model, params=out, num_samples=num_fit_samples or SAMPLES, seed=int(self.rng.integers(2**31))))
        return out


def fit_affine_calibrator(model, *, params: ENNParams, num_samples: int, seed: int, observation_noise: bool = False) -> AffineCalibrator:
    """Least squares of natural y on the leave-one-out mean of sampled rows."""
    if len(model) < 2 or num_samples <= 0:
        return AffineCalibrator.identity(model.num_outputs)
    sample = _sampled(model, num_samples, seed).select("row_id", "x", "y_natural").orderBy("row_id").collect()
    x, y = np.array([r["x"] for r in sample]), np.array([r["y_natural"] for r in sample])
    post = model.posterior(x, params=replace(params, calibrator=None), flags=PosteriorFlags(True, observation_noise))
    return AffineCalibrator.fit(post.mu, y, post.se)


