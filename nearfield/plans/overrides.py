"""Changes of a configuration by name, for callers that hold plain dictionaries."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from nearfield.plans import config as cfg

# fixed values: the names that are understood, and where each belongs
CANDIDATES = ("candidate_rv", "num_candidates_per_dim", "min_candidates", "max_candidates", "num_candidates_per_arm")
LENGTHS = ("length_init", "length_min", "length_max")
OBJECTIVES = ("num_metrics", "alpha")
FIT = {"num_fit_samples": "num_fit_samples", "num_fit_candidates": "num_fit_candidates", "infer_aleatoric_variance": "infer_aleatoric_variance_scale", "affine_calibrate": "affine_calibrate"}
SURROGATE = ("weighting", "y_bounds", "tied_dims")
OTHER = ("acquisition", "trust_region", "rescalarize", "raasp_fast", "noise_aware", "freeze_params")
KEYS = {*CANDIDATES, *LENGTHS, *OBJECTIVES, *FIT, *SURROGATE, *OTHER}
REGIONS = {"turbo": cfg.TurboTRConfig, "none": cfg.NoTRConfig}
ACQUISITIONS = {"thompson": cfg.DrawAcquisitionConfig, "ucb": cfg.UCBAcquisitionConfig, "pareto": cfg.ParetoAcquisitionConfig, "random": cfg.RandomAcquisitionConfig}


def _named(kind: type, value: object) -> object:
    return kind(value) if isinstance(value, str) else value


def _choice(what: str, choices: Mapping[str, type], value: object) -> object:
    if not isinstance(value, str):
        return value
    if value not in choices:
        raise ValueError(f"{what} {value!r} is none of {sorted(choices)}")
    return choices[value]


def with_overrides(config: cfg.OptimizerConfig, overrides: Mapping[str, object]) -> cfg.OptimizerConfig:
    """``config`` with the named values changed; None leaves a value as it is, a name that isn't
    known is an error, and the result is checked like any configuration."""
    unknown = sorted(set(overrides) - KEYS)
    if unknown:
        raise ValueError(f"no configuration value is named {', '.join(unknown)}")
    given = {k: v for k, v in overrides.items() if v is not None}

    candidates = {k: given[k] for k in CANDIDATES if k in given}
    if "candidate_rv" in candidates:
        candidates["candidate_rv"] = _named(cfg.CandidateRV, candidates["candidate_rv"])
    if "raasp_fast" in given:
        candidates["raasp_driver"] = cfg.RAASPDriver.FAST if given["raasp_fast"] else cfg.RAASPDriver.ORIG

    surrogate = config.surrogate
    inner = {**{FIT[k]: given[k] for k in FIT if k in given}, **{k: given[k] for k in SURROGATE if k in given}, **({"freeze_params": True} if given.get("freeze_params") else {})}
    if inner:
        if not isinstance(surrogate, cfg.ENNSurrogateConfig):
            raise ValueError(f"{', '.join(sorted(inner))} need a surrogate")
        fit = {k: v for k, v in inner.items() if k in FIT.values()}
        if inner.get("freeze_params"):
            if fit:
                raise ValueError("frozen scales take no values of the fit")
            surrogate = replace(surrogate, fit=cfg.ENNFitConfig())
        elif fit:
            surrogate = replace(surrogate, fit=replace(surrogate.fit, **fit))
        surrogate = replace(surrogate, **{k: inner[k] for k in SURROGATE if k in inner})

    acquisition = config.acquisition
    if "acquisition" in given:
        kind = _choice("acquisition", ACQUISITIONS, given["acquisition"])
        acquisition = kind() if isinstance(kind, type) else kind
    return replace(config, candidates=replace(config.candidates, **candidates), surrogate=surrogate, acquisition=acquisition, trust_region=_region(config.trust_region, given))


def _region(region: object, given: Mapping[str, object]) -> object:
    several = any(k in given for k in (*OBJECTIVES, "rescalarize"))
    kind = given.get("trust_region")
    if kind == "morbo" or (several and kind is None):
        if not isinstance(region, cfg.MorboTRConfig):
            if "num_metrics" not in given:
                raise ValueError("several objectives need num_metrics")
            region = cfg.MorboTRConfig(cfg.MultiObjectiveConfig(int(given["num_metrics"])))
        goals = {k: given[k] for k in OBJECTIVES if k in given}
        region = replace(region, multi_objective=replace(region.multi_objective, **goals))
        if "rescalarize" in given:
            region = replace(region, rescale_policy=cfg.RescalePolicyConfig(_named(cfg.Rescalarize, given["rescalarize"])))
    elif kind is not None:
        if several:
            raise ValueError("values for several objectives need the region for them")
        chosen = _choice("trust_region", REGIONS, kind)
        if isinstance(chosen, type):
            region = region if isinstance(region, chosen) else chosen()
        else:
            region = chosen
    lengths = {k: given[k] for k in LENGTHS if k in given}
    if lengths:
        if isinstance(region, cfg.NoTRConfig):
            raise ValueError("there is no region whose lengths could change")
        region = replace(region, length=replace(region.length, **lengths))
    if "noise_aware" in given:
        region = replace(region, noise_aware=bool(given["noise_aware"]))
    return region
