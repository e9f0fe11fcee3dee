"""The posterior family: weighted moments over neighbours, one lazy plan each.

A neighbour at squared distance d2 with variance v has the weight
``1 / (1e-9 + epi * d2 + ale + v / s^2)``, s being the population deviation of y.  Weights always
hold the aleatoric part; ``observation_noise`` only decides whether it is reported.

Observations are ``(row_id, x, y array, yvar array or null)``; results are long:
``(query_id, metric, mu, se, se_epi, se_ale, n_neighbors)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import expr
from nearfield.functions.expr import EPS_VAR
from nearfield.operators.knn import BROADCAST_BYTES, knn

#: Of a neighbour row in memory: four numbers and its overhead.
ROW_BYTES = 64
RESULT = ["query_id", "metric", "mu", "se", "se_epi", "se_ale", "n_neighbors"]


def y_scales(observations: DataFrame) -> DataFrame:
    """``(metric, y_scale, n, y_sum, y_sumsq)``: the population deviation of each metric, 1 where
    there are fewer than two rows or it isn't positive.  One partial aggregation."""
    long = observations.select(F.posexplode(expr.doubles(F.col("y"))).alias("metric", "v"))
    out = long.groupBy("metric").agg(F.count("*").alias("n"), F.sum("v").alias("y_sum"), F.sum(F.col("v") * F.col("v")).alias("y_sumsq"), F.stddev_pop("v").alias("sd"))
    scale = F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("sd")).otherwise(F.lit(1.0))
    return out.select("metric", scale.alias("y_scale"), "n", "y_sum", "y_sumsq")


def fewest_for_all(near: DataFrame) -> DataFrame:
    """Neighbour rows cut to as many a query as the query has that has the fewest."""
    fewest = near.groupBy("query_id").agg(F.max("rank").alias("m")).agg(F.min("m").alias("fewest"))
    return near.crossJoin(F.broadcast(fewest)).where("rank <= fewest").drop("fewest")  # one row


def neighbours(queries: DataFrame, observations: DataFrame, k: int, exclude_self: bool, scale: Sequence[float] | None, strategy: str | Callable[..., DataFrame]) -> DataFrame:
    """Neighbour rows with y and yvar: (query_id, rank, row_id, d2, y, yvar)."""
    found = knn(queries, observations, k, scale=scale, exclude_self=exclude_self, strategy=strategy)
    if queries.count() * (k + 1) * ROW_BYTES <= BROADCAST_BYTES:
        found = F.broadcast(found)  # then the observations are not moved
    values = observations.select(F.col("row_id").alias("n_row"), expr.doubles(F.col("y")).alias("y"), (expr.doubles(F.col("yvar")) if "yvar" in observations.columns else F.lit(None).cast("array<double>")).alias("yvar"))
    return found.join(values, F.col("row_id") == F.col("n_row")).drop("n_row")


def _weighted(near: DataFrame, scales: DataFrame, epi: Column, ale: Column, keys: list[str]) -> DataFrame:
    """Long form with weights; keys, metric, y, w, noise (the aleatoric part in units of s)."""
    long = near.select(*keys, "rank", "row_id", "d2", "yvar", F.posexplode("y").alias("metric", "v"), epi.alias("epi"), ale.alias("ale"))
    s = F.broadcast(scales.select(F.col("metric").alias("s_metric"), "y_scale"))  # one row per metric
    long = long.join(s, F.col("metric") == F.col("s_metric"))
    variance = F.coalesce(F.col("yvar")[F.col("metric")], F.lit(0.0)) / (F.col("y_scale") * F.col("y_scale"))
    noise = F.col("ale") + variance
    return long.withColumn("noise", noise).withColumn("w", 1 / (EPS_VAR + F.col("epi") * F.col("d2") + F.col("noise")))


def _moments(weighted: DataFrame, keys: list[str], observation_noise: bool) -> DataFrame:
    agg = weighted.groupBy(*keys, "metric").agg(
        F.sum("w").alias("sw"),
        (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mu"),
        (F.sum(F.col("w") * F.col("noise")) / F.sum("w")).alias("noise"),
        F.sum(F.col("w") * F.col("w")).alias("sww"),
        F.max("y_scale").alias("y_scale"),
        F.count("*").alias("n_neighbors"),
    )
    epi = 1 / F.col("sw")
    ale = F.col("noise") if observation_noise else F.lit(0.0)
    low = epi + ale < EPS_VAR
    floor = float(np.sqrt(EPS_VAR)) * F.col("y_scale")
    return agg.select(
        *keys,
        "metric",
        "mu",
        F.when(low, floor).otherwise(F.sqrt(epi + ale) * F.col("y_scale")).alias("se"),
        F.when(low, floor).otherwise(F.sqrt(epi) * F.col("y_scale")).alias("se_epi"),
        F.when(low, F.lit(0.0)).otherwise(F.sqrt(ale) * F.col("y_scale")).alias("se_ale"),
        "n_neighbors",
        (F.sqrt("sww") / F.col("sw")).alias("l2"),
    )


def with_prior(result: DataFrame, queries: DataFrame, num_metrics: int) -> DataFrame:
    """Queries without any neighbour get mean 0 and standard error 1."""
    all_keys = queries.select(F.col("query_id").alias("k_query"), F.explode(F.array(*[F.lit(m) for m in range(num_metrics)])).alias("k_metric"))
    joined = all_keys.join(result, (F.col("k_query") == F.col("query_id")) & (F.col("k_metric") == F.col("metric")), "left")
    fill = {"mu": 0.0, "se": 1.0, "se_epi": 1.0, "se_ale": 0.0}
    return joined.select(F.col("k_query").alias("query_id"), F.col("k_metric").alias("metric"), *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()], F.coalesce("n_neighbors", F.lit(0)).alias("n_neighbors"))


def posterior(
    queries: DataFrame,
    observations: DataFrame,
    k: int,
    epi: float = 1.0,
    ale: float = 0.0,
    *,
    exclude_nearest: bool = False,
    observation_noise: bool = False,
    scale: Sequence[float] | None = None,
    scales: DataFrame | None = None,
    strategy: str = "auto",
    strict_batch_k: bool = False,
    near: DataFrame | None = None,
) -> DataFrame:
    """Mean and standard errors of every query and metric.  Queries without neighbours are not in
    the result; :func:`with_prior` adds them.  With ``strict_batch_k`` all queries use as many
    neighbours as the one that has the fewest.  ``near`` holds the neighbour rows where they are
    there already."""
    if near is None:
        near = neighbours(queries, observations, k, exclude_nearest, scale, strategy)
    if strict_batch_k:
        near = fewest_for_all(near)
    weighted = _weighted(near, scales if scales is not None else y_scales(observations), F.lit(float(epi)), F.lit(float(ale)), ["query_id"])
    return _moments(weighted, ["query_id"], observation_noise).select(*RESULT)


def batch_posterior(queries: DataFrame, observations: DataFrame, params: DataFrame, *, exclude_nearest: bool = False, observation_noise: bool = False, scale: Sequence[float] | None = None, scales: DataFrame | None = None, strategy: str = "auto", near: DataFrame | None = None) -> DataFrame:
    """The posterior for every row of ``params(param_id, k, epi, ale)``: one search at the largest
    k, then each parameter row takes the ranks it wants.  ``near`` holds the result of that search
    where it is there already."""
    if near is None:
        most = params.agg(F.max("k")).first()[0]
        if most is None:
            raise ValueError("at least one parameter row is needed")
        near = neighbours(queries, observations, int(most), exclude_nearest, scale, strategy)
    # parameter rows are written by hand or by a fitter: tens of rows
    per = near.crossJoin(F.broadcast(params.select("param_id", "k", "epi", "ale"))).where(F.col("rank") <= F.col("k"))
    keys = ["param_id", "query_id"]
    weighted = _weighted(per.withColumnsRenamed({"epi": "p_epi", "ale": "p_ale"}), scales if scales is not None else y_scales(observations), F.col("p_epi"), F.col("p_ale"), keys)
    return _moments(weighted, keys, observation_noise).select("param_id", *RESULT)


def joined_with_whatif(observations: DataFrame, whatif: DataFrame) -> DataFrame:
    """Observations and hypothetical rows together; these have variance 0 if any row has one."""
    has = "yvar" in observations.columns
    base = observations.select("row_id", expr.doubles(F.col("x")).alias("x"), expr.doubles(F.col("y")).alias("y"), *([expr.doubles(F.col("yvar")).alias("yvar")] if has else []))
    extra = whatif.select("row_id", expr.doubles(F.col("x")).alias("x"), expr.doubles(F.col("y")).alias("y"))
    if has:
        extra = extra.withColumn("yvar", F.transform("y", lambda v: F.lit(0.0)))
    return base.unionByName(extra)


def conditional_posterior(queries: DataFrame, observations: DataFrame, whatif: DataFrame, k: int, epi: float = 1.0, ale: float = 0.0, **options: object) -> DataFrame:
    """The posterior as if ``whatif(row_id, x, y)`` had been observed too; y's deviation is taken
    over both."""
    return posterior(queries, joined_with_whatif(observations, whatif), k, epi, ale, **options)


def naturalize(result: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Means and standard errors of warped y in natural units, by the slope at the mean."""
    mu, slope = F.col("mu"), F.lit(1.0)
    for j, (lo, hi) in enumerate(np.asarray(bounds, float)):
        if np.isfinite(lo) or np.isfinite(hi):
            mu = F.when(F.col("metric") == j, expr.unwarp(F.col("mu"), float(lo), float(hi))).otherwise(mu)
            slope = F.when(F.col("metric") == j, F.abs(expr.unwarp_slope(F.col("mu"), float(lo), float(hi)))).otherwise(slope)
    return result.withColumn("slope", slope).withColumns({"mu": mu, **{c: F.col(c) * F.col("slope") for c in ("se", "se_epi", "se_ale")}}).drop("slope")


def warp_observations(observations: DataFrame, bounds: np.ndarray) -> DataFrame:
    """y (and yvar) on the line; a y outside its open interval fails the query."""
    y = expr.doubles(F.col("y"))
    checked = [F.when(expr.inside(y[j], lo, hi), y[j]).otherwise(F.raise_error(F.lit(f"y of metric {j} is outside its bounds")).cast("double")) for j, (lo, hi) in enumerate(np.asarray(bounds, float).tolist())]
    warped = F.array(*[expr.warp(c, lo, hi) for c, (lo, hi) in zip(checked, np.asarray(bounds, float).tolist())])
    out = observations.withColumn("y_natural", y)
    if "yvar" in observations.columns:
        v = expr.doubles(F.col("yvar"))
        out = out.withColumn("yvar", F.when(v.isNotNull(), F.array(*[expr.warp_variance(v[j], y[j], lo, hi) for j, (lo, hi) in enumerate(np.asarray(bounds, float).tolist())])))
    return out.withColumn("y", warped)


def confidence_interval(result: DataFrame, z: float, bounds: np.ndarray | None = None) -> DataFrame:
    """``lower`` and ``upper``: mu -/+ z * se; on the line where y is bounded."""
    low, high = F.col("mu") - z * F.col("se"), F.col("mu") + z * F.col("se")
    out = result.withColumns({"lower": low, "upper": high})
    if bounds is not None:
        for j, (lo, hi) in enumerate(np.asarray(bounds, float).tolist()):
            if np.isfinite(lo) or np.isfinite(hi):
                z_mu = expr.warp(F.col("mu"), lo, hi)
                z_se = F.col("se") / F.abs(expr.unwarp_slope(z_mu, lo, hi))
                here = F.col("metric") == j
                out = out.withColumns({c: F.when(here, expr.unwarp(z_mu + sign * z * z_se, lo, hi)).otherwise(F.col(c)) for c, sign in (("lower", -1), ("upper", 1))})
    return out


def function_draws(queries: DataFrame, observations: DataFrame, k: int, epi: float, ale: float, seeds: Sequence[int], *, exclude_nearest: bool = False, observation_noise: bool = False, scale: Sequence[float] | None = None, strategy: str = "auto", near: DataFrame | None = None) -> DataFrame:
    """Joint draws ``(query_id, metric, seed, value)``: queries that share neighbours share their
    random numbers, which depend on (seed, row id, metric).  Observation noise goes by
    ``queries.position`` if there is one, else by the query id.  ``near`` holds the neighbour rows
    where they are there already."""
    from nearfield.functions.random_hash import normal_column, query_normal_column

    if near is None:
        near = neighbours(queries, observations, k, exclude_nearest, scale, strategy)
    weighted = _weighted(near, y_scales(observations), F.lit(float(epi)), F.lit(float(ale)), ["query_id"])
    moments = _moments(weighted, ["query_id"], observation_noise)
    per_seed = weighted.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])))
    shocked = per_seed.withColumn("z", normal_column(F.col("seed"), F.col("row_id"), F.col("metric")))
    sums = shocked.groupBy("query_id", "metric", "seed").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("shock"))
    m = moments.select(F.col("query_id").alias("m_query"), F.col("metric").alias("m_metric"), "mu", "se_epi", "se_ale", "l2")
    out = sums.join(m, (F.col("query_id") == F.col("m_query")) & (F.col("metric") == F.col("m_metric")))
    value = F.col("mu") + F.col("se_epi") / F.greatest("l2", F.lit(1e-12)) * F.col("shock")
    if observation_noise:
        if "position" in queries.columns:
            where = queries.select(F.col("query_id").alias("p_query"), "position")
            out = out.join(where, F.col("query_id") == F.col("p_query"))
        position = F.col("position") if "position" in queries.columns else F.col("query_id")
        value = value + F.col("se_ale") * query_normal_column(F.col("seed"), position, F.col("metric"))
    return out.select("query_id", "metric", "seed", value.alias("value"))


def sample(result: DataFrame, num_samples: int, seed: int) -> DataFrame:
    """Independent normals around every mean: ``(query_id, metric, sample, value)``.  A sample is a
    hash of (seed, query, metric, sample), so it doesn't depend on partitions."""
    from nearfield.functions.random_hash import normal_column

    many = result.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))))
    z = normal_column(F.xxhash64(F.lit(int(seed)), F.col("sample")), F.col("query_id"), F.col("metric"))
    return many.select("query_id", "metric", "sample", (F.col("mu") + F.col("se") * z).alias("value"))


def upper_confidence(post: DataFrame, beta: float, arms: int) -> DataFrame:
    """``(query_id, ucb)``: the ``arms`` queries of greatest mu + beta * se, ties to the smaller id."""
    ucb = post.select("query_id", (F.col("mu") + beta * F.col("se")).alias("ucb"))
    return ucb.orderBy(F.desc("ucb"), "query_id").limit(arms)
