"""Pareto fronts, dominance layers, hypervolume, incumbents and ranges.

The running maximum of a front needs one order over all points.  Points are therefore reduced
first: a point that another one of its task dominates leaves the task's local front, and only
local fronts meet in the final window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.sources.scratch import dropped, written


def _local_front(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: pd.DataFrame | None = None
    for part in pdf:
        both = (part if held is None else pd.concat([held, part])).drop_duplicates().sort_values(["a", "b"], ascending=False, kind="stable")
        best = both["b"].cummax().shift(1, fill_value=-np.inf)
        held = both[both["b"] > best]
    if held is not None:
        yield held


def pareto_front(points: DataFrame) -> DataFrame:
    """The rows of ``points(id, a, b)`` that no other point exceeds in one and reaches in the
    other; equal points stay together."""
    values = points.select(F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    local = values.mapInPandas(_local_front, "a double, b double").distinct()
    w = Window.orderBy(F.desc("a"), F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    front = local.withColumn("best", F.max("b").over(w)).where(F.col("best").isNull() | (F.col("b") > F.col("best"))).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    return points.join(front, (F.col("a").cast("double") == F.col("fa")) & (F.col("b").cast("double") == F.col("fb"))).select(*points.columns)


def pareto_layers(points: DataFrame, layers: int) -> DataFrame:
    """``(id, a, b, layer)`` for the first ``layers`` fronts, each found among what is left."""
    rest, out = points, None
    for k in range(layers):
        # written: the next layer would run this one's plan three times
        front = written(pareto_front(rest), "pareto-front")
        found = front.withColumn("layer", F.lit(k))
        out = found if out is None else out.unionByName(found)
        if k < layers - 1:
            gone = front.select(F.col("id").alias("gone"))
            left = written(rest.join(gone, F.col("id") == F.col("gone"), "left_anti"), "pareto-rest")
            dropped(rest)
            rest = left
    return out


def dominance_layers(points: np.ndarray) -> np.ndarray:
    """The layer of each row of an array of objectives (bounded: candidates of one round)."""
    p = np.asarray(points, float)
    layer, left, k = np.full(len(p), -1), np.arange(len(p)), 0
    while len(left):
        q = p[left]
        beaten = np.array([((q >= x).all(axis=1) & (q > x).any(axis=1)).any() for x in q])
        layer[left[~beaten]] = k
        left, k = left[beaten], k + 1
    return layer


def hypervolume(points: DataFrame, reference: tuple[float, float]) -> DataFrame:
    """One row: the area that ``points(a, b)`` dominate above the reference point."""
    r0, r1 = map(float, reference)
    above = points.select(F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).where((F.col("a") > r0) & (F.col("b") > r1))
    front = above.mapInPandas(_local_front, "a double, b double").distinct()
    w = Window.orderBy(F.desc("a"), F.desc("b"))
    best = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, 0))
    strips = front.withColumn("step", F.col("a") - F.coalesce(F.lead("a").over(w), F.lit(r0))).withColumn("best", best)
    return strips.agg(F.coalesce(F.sum(F.col("step") * (F.col("best") - r1)), F.lit(0.0)).alias("hypervolume"))


def top_m(observations: DataFrame, m: int, metric: str) -> DataFrame:
    """The m greatest of a column, equal values by id."""
    return observations.orderBy(F.desc(metric), F.asc("row_id")).limit(m)


def incumbents(observations: DataFrame, metrics: list[str], m: int, noise_aware: bool = False) -> DataFrame:
    """Ids ``row_id``: all rows that reach the greatest value (one metric, no noise), the m best
    (one metric, noise), or the union of the m best of each metric."""
    if len(metrics) == 1 and not noise_aware:
        best = observations.agg(F.max(metrics[0]).alias("best"))
        return observations.crossJoin(F.broadcast(best)).where(F.col(metrics[0]) == F.col("best")).select("row_id")
    out = top_m(observations, m, metrics[0]).select("row_id")
    for c in metrics[1:]:
        out = out.unionByName(top_m(observations, m, c).select("row_id"))
    return out.distinct()


def scalarize(observations: DataFrame, metrics: list[str], weights: list[float], alpha: float = 0.05, clip: bool = True) -> DataFrame:
    """``score``: least weighted range-normalised metric plus alpha times their sum."""
    ranges = observations.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in metrics for n, f in (("lo", F.min), ("hi", F.max))])
    parts = []
    for c, weight in zip(metrics, weights):
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        z = F.when(span > 0, (F.col(c) - F.col(f"lo_{c}")) / F.when(span > 0, span)).otherwise(F.lit(0.5))
        parts.append((F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0)) if clip else z) * weight)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    low = F.least(*parts) if len(parts) > 1 else parts[0]
    return observations.crossJoin(F.broadcast(ranges)).withColumn("score", low + alpha * total).select(*observations.columns, "score")
