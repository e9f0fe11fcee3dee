"""Nearest-neighbour regression and black-box optimization on Spark tables.

Names are loaded when they are first used.
"""

from __future__ import annotations

from importlib import import_module

_CONFIG = "OptimizerConfig turbo_zero_config turbo_enn_config lhd_only_config TurboTRConfig MorboTRConfig NoTRConfig CandidateRV InitStrategy AcqType ENNSurrogateConfig ENNFitConfig NoSurrogateConfig MultiObjectiveConfig CandidateGenConfig TRLengthConfig Rescalarize RAASPDriver ENNMetricLearning ObservationHistoryConfig"
_WHERE = {
    "EpistemicNearestNeighbors": "api",
    "ENNStatefulFitter": "plans.fitter",
    "AffineCalibrator": "plans.calibrator",
    "fit_affine_calibrator": "plans.fitter",
    "create_optimizer": "plans.optimizer",
    "Optimizer": "plans.optimizer",
    "Telemetry": "plans.optimizer",
    "CatEncoder": "operators.encode",
    "CatEncoding": "operators.encode",
    "DimKind": "operators.encode",
    "MetricPolicy": "plans.metric",
    "with_overrides": "plans.overrides",
    "ENNParams": "plans.fitter",
    "PosteriorFlags": "plans.fitter",
    "ENNNormal": "plans.calibrator",
    **dict.fromkeys(_CONFIG.split(), "plans.config"),
}
__all__ = list(_WHERE)


def __getattr__(name: str) -> object:
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
