"""``python -m nearfield.cli``: quality checks and scaling probes, one JSON line each.

    qa ackley | y-bounds | acquisition | y-var-noise
    stress model | draw | proposal
    evaluate list | run [NAME]
"""

from __future__ import annotations

import argparse
import json
import tempfile
import time

import numpy as np

import nearfield as nf
from nearfield import benchmarks
from nearfield.plans import statistics


def _model(x, y, yvar=None, **options):
    return nf.EpistemicNearestNeighbors(x, y, yvar, work_dir=tempfile.mkdtemp(prefix="nearfield-"), **options)


def _optimize(config, f, bounds, rounds: int, arms: int, seed: int) -> dict:
    t = time.perf_counter()
    o = nf.create_optimizer(bounds=bounds, config=config, seed=seed, work_dir=tempfile.mkdtemp(prefix="nearfield-"))
    best = []
    for _ in range(rounds):
        x = o.ask(arms)
        o.tell(x, f(x).reshape(arms, -1))
        best.append(float(o.best_y[0]))
    o.close()
    return {"best": best[-1], "auc": float(np.mean(best)), "seconds": time.perf_counter() - t}


def ackley(dim: int = 9, rounds: int = 10, arms: int = 10) -> dict:
    enn = nf.ENNSurrogateConfig(k=10)
    f = benchmarks.Ackley(0.1, 0)
    return _optimize(nf.turbo_enn_config(enn=enn), f, [[-32.768, 32.768]] * dim, rounds, arms, 0)


def acquisition(rounds: int = 6, arms: int = 5) -> dict:
    fit = nf.ENNSurrogateConfig(k=10, fit=nf.ENNFitConfig(num_fit_samples=10, num_fit_candidates=10))
    few = nf.CandidateGenConfig(max_candidates=200)
    return {kind.value: _optimize(nf.turbo_enn_config(enn=fit, acq_type=kind, candidates=few), benchmarks.Ackley(0.0, 0), [[-32.768, 32.768]] * 5, rounds, arms, 0) for kind in nf.AcqType}


def _scores(y, post) -> dict:
    e = y - post.mu
    ll = -0.5 * np.log(2 * np.pi * post.se**2) - 0.5 * (e / post.se) ** 2
    return {"nll": float(-ll.mean()), "rmse": float(np.sqrt((e**2).mean())), "mae": float(np.abs(e).mean()), "nrmse": float(np.sqrt((e**2).mean()) / y.std()), "within_one_se": float((np.abs(e) <= post.se).mean())}


def y_bounds(n: int = 300) -> dict:
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (n, 1))
    y = np.exp(np.sin(2 * np.pi * x) + 0.15 * rng.standard_normal((n, 1)))
    m = _model(x[: n // 2], y[: n // 2], y_bounds=[[0.0, np.inf]])
    post = m.posterior(x[n // 2 :], params=nf.ENNParams(10, 1.0, 0.1), flags=nf.PosteriorFlags(False, True))
    m.close()
    return _scores(y[n // 2 :], post) | {"outside": float((post.mu <= 0).mean())}


def y_var_noise(n: int = 300) -> dict:
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (n, 1))
    y = np.sin(2 * np.pi * x) + 0.3 * rng.standard_normal((n, 1))
    out = {}
    for name, v in (("matched", 0.09), ("none", None), ("wrong", 9.0)):
        yvar = None if v is None else np.full((n // 2, 1), v)
        m = _model(x[: n // 2], y[: n // 2], yvar)
        out[name] = _scores(y[n // 2 :], m.posterior(x[n // 2 :], params=nf.ENNParams(10, 1.0, 0.0), flags=nf.PosteriorFlags(False, True)))
        m.close()
    return out


def stress_model(n: int = 100_000, d: int = 10, queries: int = 1000, k: int = 10) -> dict:
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((n, d)), rng.standard_normal((n, 1))
    t = time.perf_counter()
    m = _model(x, y)
    added = time.perf_counter() - t
    t = time.perf_counter()
    m.neighbors(rng.standard_normal((queries, d)), k)
    out = {"n": n, "add_seconds": added, "query_seconds": time.perf_counter() - t, "bytes": m.index_memory_bytes()}
    m.close()
    return out


def stress_draw(n: int = 1000, draws: int = 100) -> dict:
    rng = np.random.default_rng(0)
    x = rng.random((n, 10))
    m = _model(x, benchmarks.quadratic(x, rng)[:, None])
    t = time.perf_counter()
    values, _ = m.posterior_function_draw(rng.random((50, 10)), params=nf.ENNParams(10, 1.0, 0.1), function_seeds=np.arange(draws))
    m.close()
    return {"seconds": time.perf_counter() - t, "spread": float(values.std(axis=2).mean())}


def stress_proposal(n: int = 1000, arms: int = 4) -> dict:
    o = nf.create_optimizer(bounds=[[0, 1]] * 5, config=nf.turbo_enn_config(enn=nf.ENNSurrogateConfig(k=10)), seed=0, work_dir=tempfile.mkdtemp(prefix="nearfield-"))
    x = np.random.default_rng(0).random((n, 5))
    o.tell(x, benchmarks.sphere(x)[:, None])
    t = time.perf_counter()
    o.ask(arms)
    out = {"n": n, "ask_seconds": time.perf_counter() - t}
    o.close()
    return out


def prediction(n: int = 400) -> dict:
    rng = np.random.default_rng(0)
    x = rng.random((n, 12))
    y = benchmarks.sparse_sine(x, rng)[:, None]
    m = _model(x[: n // 2], y[: n // 2], weighting=True)
    out = _scores(y[n // 2 :], m.posterior(x[n // 2 :], params=nf.ENNParams(10, 1.0, 0.1), flags=nf.PosteriorFlags(False, True)))
    out["weights"] = statistics.dependence_weights(x, y).round(4).tolist()
    m.close()
    return out


COMMANDS = {
    "qa": {"ackley": ackley, "y-bounds": y_bounds, "acquisition": acquisition, "y-var-noise": y_var_noise},
    "stress": {"model": stress_model, "draw": stress_draw, "proposal": stress_proposal},
}
EVALUATIONS = {"prediction": prediction, "optimization": acquisition, "scaling": stress_model}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="nearfield", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    groups = parser.add_subparsers(dest="group", required=True)
    for group, commands in COMMANDS.items():
        groups.add_parser(group).add_argument("command", choices=list(commands))
    evaluate = groups.add_parser("evaluate")
    evaluate.add_argument("command", choices=["list", "run"])
    evaluate.add_argument("name", nargs="?", choices=list(EVALUATIONS))
    a = parser.parse_args(args)
    if a.group == "evaluate":
        names = list(EVALUATIONS) if a.name is None else [a.name]
        for n in names:
            print(n if a.command == "list" else json.dumps({n: EVALUATIONS[n]()}))
    else:
        print(json.dumps({a.command: COMMANDS[a.group][a.command]()}))


if __name__ == "__main__":
    main()
