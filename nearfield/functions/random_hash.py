"""Random numbers that depend on (seed, row, metric) only: the same on every partition.

``normal_hash`` is the fast family, SplitMix64 with the Box-Muller transform; ``philox_hash`` draws
one uniform from NumPy's Philox per key and inverts the normal distribution.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
# fixed values: SplitMix64 and the key layout
GOLDEN = U(0x9E3779B97F4A7C15)
MULT1 = U(0xBF58476D1CE4E5B9)
MULT2 = U(0x94D049BB133111EB)
SECOND = U(0xD2B74407B1CE6E93)
QUERY_SALT = U(0xC0FFEE00D15CA11E)
PRIME = U(1_000_003)


def as_u64(values: object) -> np.ndarray:
    a = np.asarray(values)
    return a.astype(np.uint64) if a.dtype == np.uint64 else a.astype(np.int64).view(np.uint64)


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = as_u64(x) + GOLDEN
        z = (z ^ (z >> U(30))) * MULT1
        z = (z ^ (z >> U(27))) * MULT2
    return z ^ (z >> U(31))


def _normal(key: np.ndarray) -> np.ndarray:
    unit = lambda k: (splitmix64(k) >> U(11)).astype(np.float64) / 2.0**53
    u1 = np.clip(unit(key), 1e-12, 1 - 1e-12)
    return np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * unit(key ^ SECOND))


def normal_hash(seed: object, row: object, metric: object) -> np.ndarray:
    """Standard normals for keys of broadcastable shapes."""
    with np.errstate(over="ignore"):
        return _normal((as_u64(seed) * PRIME + as_u64(row)) * PRIME + as_u64(metric))


def query_normal_hash(seed: object, position: object, metric: object) -> np.ndarray:
    """A second family, for observation noise by position of the query."""
    with np.errstate(over="ignore"):
        return _normal((as_u64(seed) * PRIME + as_u64(position)) * PRIME + QUERY_SALT + as_u64(metric))


def _check_metrics(num_metrics: int) -> int:
    if num_metrics <= 0:
        raise ValueError(f"{num_metrics} metrics: at least one is needed")
    return num_metrics


def normal_hash_batch_multi_seed_fast(function_seeds: object, data_indices: object, num_metrics: int) -> np.ndarray:
    """Shape (seeds, *indices, metrics)."""
    seeds, idx = np.asarray(function_seeds, np.int64), np.asarray(data_indices, np.int64)
    m = np.arange(_check_metrics(num_metrics))
    return normal_hash(seeds.reshape(-1, *[1] * (idx.ndim + 1)), idx[..., None], m)


def normal_hash_batch_multi_seed(function_seeds: object, data_indices: object, num_metrics: int) -> np.ndarray:
    """As above, from Philox; each distinct key is drawn once."""
    from nearfield.functions.numeric import ndtri

    seeds, idx = np.asarray(function_seeds, np.int64), np.asarray(data_indices, np.int64)
    distinct, which = np.unique(idx, return_inverse=True)
    with np.errstate(over="ignore"):
        key = (as_u64(seeds)[:, None, None] * PRIME + as_u64(distinct)[None, :, None]) * PRIME + np.arange(_check_metrics(num_metrics), dtype=np.uint64)
    drawn = np.array([np.random.Generator(np.random.Philox(int(k))).random() for k in key.ravel()])
    out = np.array([ndtri(u) for u in np.clip(drawn, 1e-10, 1 - 1e-10)]).reshape(key.shape)
    return out[:, which.ravel()].reshape(len(seeds), *idx.shape, num_metrics)


@lru_cache(1)
def _udfs() -> tuple:
    def rows(seed: pd.Series, row: pd.Series, metric: pd.Series) -> pd.Series:
        return pd.Series(normal_hash(seed.to_numpy(), row.to_numpy(), metric.to_numpy()))

    def queries(seed: pd.Series, row: pd.Series, metric: pd.Series) -> pd.Series:
        return pd.Series(query_normal_hash(seed.to_numpy(), row.to_numpy(), metric.to_numpy()))

    return F.pandas_udf(rows, "double"), F.pandas_udf(queries, "double")


def normal_column(seed: Column, row: Column, metric: Column) -> Column:
    """:func:`normal_hash` of long columns, in Arrow batches."""
    return _udfs()[0](seed.cast("long"), row.cast("long"), metric.cast("long"))


def query_normal_column(seed: Column, position: Column, metric: Column) -> Column:
    return _udfs()[1](seed.cast("long"), position.cast("long"), metric.cast("long"))


def choose_indices(n: int, p: int, seed: int) -> np.ndarray:
    """``p`` of ``n`` positions without replacement, in the order drawn."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)[: min(n, p)]


class NumpyNormal:
    """Standard normals of a PCG64 generator whose 128-bit state and increment are given in halves."""

    def __init__(self, state_hi: int, state_lo: int, inc_hi: int, inc_lo: int) -> None:
        bits = np.random.PCG64(0)
        bits.state = {"bit_generator": "PCG64", "state": {"state": int(state_hi) << 64 | int(state_lo), "inc": int(inc_hi) << 64 | int(inc_lo)}, "has_uint32": 0, "uinteger": 0}
        self._rng = np.random.Generator(bits)

    def standard_normals(self, n: int) -> np.ndarray:
        return self._rng.standard_normal(n)
