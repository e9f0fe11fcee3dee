"""Registered queries over the bundled tables, with the same result in DuckDB's SQL.

Searches take as queries every row whose id is divisible by 20, against all rows.  Floating
results are rounded to six places on both sides; ties break by a unique key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import expr
from nearfield.functions.random_hash import normal_column, query_normal_column
from nearfield.operators import encode, fit, fronts, knn, posterior, sobol
from nearfield.plans.fitter import candidate_params
from nearfield.sources.cells import CellIndex
from nearfield.sources.scratch import leased_path
from nearfield.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) + 0.0 for n in names})


# ------------------------------------------------------------------ neighbours

D2 = "list_sum(list_transform(list_zip(qx, tx), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"
NEAR = f"""
q as (select vec_id as qid, embedding as qx from embeddings where vec_id % 20 = 0),
t as (select vec_id as tid, embedding as tx, label::double as y, 0.01 * (1 + label) as yvar from embeddings),
d as (select qid, tid, y, yvar, {D2} as d2 from q cross join t),
r as (select *, row_number() over (partition by qid order by d2, tid) as rk from d),
e as (select *, min(case when d2 <= 1e-15 then rk end) over (partition by qid) as srk from r),
x as (select qid, tid, y, yvar, d2, case when srk is not null and rk > srk then rk - 1 else rk end as rk from e where srk is null or rk <> srk),
s as (select case when count(*) >= 2 and stddev_pop(y) > 0 then stddev_pop(y) else 1.0 end as ys from t)"""
POST = ["mu", "se", "se_epi", "se_ale"]


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    o = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"), F.array(F.col("label").cast("double")).alias("y"))
    return q, o


def with_yvar(o: DataFrame) -> DataFrame:
    return o.withColumn("yvar", F.transform("y", lambda v: 0.01 * (1 + v)))


@query(f"with {NEAR} select qid as query_id, rk::int as rank, tid as row_id, round(d2, 6) as d2 from r where rk <= 10")
def knn_topk(spark, sf_dir):
    return rounded(knn.knn(*vectors(spark, sf_dir), 10), "d2")


@query(ORACLES["knn_topk"])
def knn_grid(spark, sf_dir):
    return rounded(knn.knn(*vectors(spark, sf_dir), 10, strategy="grid"), "d2")


@query(ORACLES["knn_topk"])
def knn_sql(spark, sf_dir):
    return rounded(knn.knn(*vectors(spark, sf_dir), 10, strategy="sql"), "d2")


@query(f"with {NEAR} select qid as query_id, rk::int as rank, tid as row_id, round(d2, 6) as d2 from x where rk <= 10")
def knn_exclude_self(spark, sf_dir):
    return rounded(knn.knn(*vectors(spark, sf_dir), 10, exclude_self=True), "d2")


SCALED = f"""with q as (select vec_id as qid, list_transform(embedding, lambda v, i: v::double / (1 + (i - 1) % 3)) as qx from embeddings where vec_id % 20 = 0),
t as (select vec_id as tid, list_transform(embedding, lambda v, i: v::double / (1 + (i - 1) % 3)) as tx from embeddings),
d as (select qid, tid, {D2} as d2 from q cross join t)
select qid as query_id, row_number() over (partition by qid order by d2, tid)::int as rank, tid as row_id, round(d2, 6) as d2 from d qualify rank <= 5"""


@query(SCALED)
def knn_scaled(spark, sf_dir):
    return rounded(knn.knn(*vectors(spark, sf_dir), 5, scale=[1.0 + j % 3 for j in range(64)]), "d2")


#: Rows a cell holds in the registered queries, whose tables are small.
QUERY_CELL_ROWS = 64


def cells_of(o: DataFrame) -> CellIndex:
    return CellIndex.build(o, leased_path(o.sparkSession, "cells"), cell_rows=QUERY_CELL_ROWS)


@query(ORACLES["knn_exclude_self"])
def knn_cells(spark, sf_dir):
    """The exact search through an index of cells."""
    q, o = vectors(spark, sf_dir)
    return rounded(cells_of(o).knn(q, 10, exclude_self=True), "d2")


@query()
def knn_recall(spark, sf_dir):
    """The share of the true neighbours that a search finds in the nearest quarter and half of the
    cells.  No SQL: the cells are not a table."""
    q, o = vectors(spark, sf_dir)
    cells, exact = cells_of(o), knn.knn(q, o, 10)
    parts = [knn.recall(cells.knn(q, 10, budget=-(-len(cells.leaves) // share)), exact).select(F.lit(1 / share).alias("share"), F.round("recall", 6).alias("recall")) for share in (4, 2)]
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------------ posteriors


def moments_sql(rows: str, epi: float = 1.0, ale: float = 0.1, noise: bool = False, yvar: bool = False, keys: str = "qid", names: str = "qid as query_id, 0 as metric", scale: str = "s", k: str = "10") -> str:
    v = "yvar / (ys * ys)" if yvar else "0.0"
    total = "1 / sum(w) + " + ("sum(w * n) / sum(w)" if noise else "0.0")
    return f"""select {names}, round(sum(w * y) / sum(w), 6) as mu,
round(case when {total} < 1e-9 then sqrt(1e-9) else sqrt({total}) end * max(ys), 6) as se,
round(case when {total} < 1e-9 then sqrt(1e-9) else sqrt(1 / sum(w)) end * max(ys), 6) as se_epi,
round(case when {total} < 1e-9 then 0.0 else sqrt({'sum(w * n) / sum(w)' if noise else '0.0'}) end * max(ys), 6) as se_ale,
count(*) as n_neighbors
from (select *, {ale} + {v} as n, 1 / (1e-9 + {epi} * d2 + {ale} + {v}) as w from {rows}, {scale} where rk <= {k}) group by {keys}"""


@query(f"with {NEAR} {moments_sql('r')}")
def posterior_single(spark, sf_dir):
    return rounded(posterior.posterior(*vectors(spark, sf_dir), 10, 1.0, 0.1), *POST)


@query(f"with {NEAR} {moments_sql('x', noise=True)}")
def posterior_noise_leave_one_out(spark, sf_dir):
    return rounded(posterior.posterior(*vectors(spark, sf_dir), 10, 1.0, 0.1, exclude_nearest=True, observation_noise=True), *POST)


@query(f"with {NEAR} {moments_sql('r', noise=True, yvar=True)}")
def posterior_yvar(spark, sf_dir):
    q, o = vectors(spark, sf_dir)
    return rounded(posterior.posterior(q, with_yvar(o), 10, 1.0, 0.1, observation_noise=True), *POST)


@query(
    f"""with {NEAR},
m as (select qid, rk, d2, unnest([0, 1]) as metric, unnest([y, tx0]) as y, 0.0 as yvar from (select r.*, embeddings.embedding[1]::double as tx0 from r join embeddings on tid = vec_id)),
s2 as (select unnest([0, 1]) as sm, unnest([(select stddev_pop(label::double) from embeddings), (select stddev_pop(embedding[1]::double) from embeddings)]) as ys)
{moments_sql('(select * from m join s2 on metric = sm)', scale='(select 1 as one)', keys='qid, metric', names='qid as query_id, metric')}"""
)
def posterior_multi_metric(spark, sf_dir):
    q, o = vectors(spark, sf_dir)
    o = o.withColumn("y", F.array(F.col("y")[0], expr.doubles(F.col("x"))[0]))
    return rounded(posterior.posterior(q, o, 10, 1.0, 0.1), *POST)


@query(
    f"""with {NEAR}, p as (select unnest([0, 1, 2]) as param_id, unnest([10, 5, 10]) as k, unnest([1.0, 0.5, 3.0]::double[]) as epi, unnest([0.1, 0.01, 0.0]::double[]) as ale)
select param_id, qid as query_id, 0 as metric, round(sum(w * y) / sum(w), 6) as mu,
round(sqrt(greatest(1 / sum(w), 1e-9)) * max(ys), 6) as se, round(sqrt(greatest(1 / sum(w), 1e-9)) * max(ys), 6) as se_epi, 0.0::double as se_ale, count(*) as n_neighbors
from (select r.*, param_id, ys, 1 / (1e-9 + epi * d2 + ale) as w from r, p, s where rk <= k) group by param_id, qid"""
)
def batch_posterior(spark, sf_dir):
    params = spark.createDataFrame([(0, 10, 1.0, 0.1), (1, 5, 0.5, 0.01), (2, 10, 3.0, 0.0)], "param_id int, k int, epi double, ale double")
    return rounded(posterior.batch_posterior(*vectors(spark, sf_dir), params), *POST)


@query(
    f"""with q as (select vec_id as qid, embedding as qx from embeddings where vec_id % 20 = 0),
t as (select vec_id as tid, embedding as tx, label::double as y from embeddings union all select 1000000 + vec_id, list_transform(embedding, lambda v: (v * 0.5)::float), 20.0 from embeddings where vec_id < 5),
d as (select qid, tid, y, {D2} as d2 from q cross join t),
r as (select *, row_number() over (partition by qid order by d2, tid) as rk from d),
s as (select stddev_pop(y) as ys from t) {moments_sql('r')}"""
)
def conditional_posterior(spark, sf_dir):
    q, o = vectors(spark, sf_dir)
    whatif = table(spark, sf_dir, "embeddings").where("vec_id < 5").select((F.col("vec_id") + 1_000_000).alias("row_id"), F.transform("embedding", lambda v: (v * F.lit(0.5)).cast("float")).alias("x"), F.array(F.lit(20.0)).alias("y"))
    return rounded(posterior.conditional_posterior(q, o, whatif, 10, 1.0, 0.1), *POST)


Z = 1.959963984540054


@query(f"with {NEAR}, p as ({moments_sql('r').replace('round(', '(').replace(', 6)', ')')}) select query_id, metric, round(mu, 6) as mu, round(mu - {Z} * se, 6) as lower, round(mu + {Z} * se, 6) as upper from p")
def confidence_interval(spark, sf_dir):
    post = posterior.posterior(*vectors(spark, sf_dir), 10, 1.0, 0.1)
    return rounded(posterior.confidence_interval(post, Z).select("query_id", "metric", "mu", "lower", "upper"), "mu", "lower", "upper")


PARTS = """q as (select p_partkey as qid, p_retailprice as a, p_size::double as b from part where p_partkey % 20 = 0),
t as (select p_partkey as tid, p_retailprice as ta, p_size::double as tb, ln(((p_size - 0.0) / 60.0) / (1 - (p_size - 0.0) / 60.0)) as y from part),
d as (select qid, tid, y, (a / 100.0 - ta / 100.0) * (a / 100.0 - ta / 100.0) as d2 from q cross join t),
r as (select *, row_number() over (partition by qid order by d2, tid) as rk from d),
s as (select stddev_pop(y) as ys from t)"""


@query(
    f"""with {PARTS}, p as ({moments_sql('r').replace('round(', '(').replace(', 6)', ')')}), n as (select *, 1 / (1 + exp(-mu)) as sg from p)
select query_id, metric, round(60 * sg, 6) as mu, round(se * 60 * sg * (1 - sg), 6) as se, round(se_epi * 60 * sg * (1 - sg), 6) as se_epi, round(se_ale * 60 * sg * (1 - sg), 6) as se_ale, n_neighbors from n"""
)
def posterior_bounded(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    bounds = np.array([[0.0, 60.0]])
    o = part.select(F.col("p_partkey").alias("row_id"), F.array("p_retailprice").alias("x"), F.array(F.col("p_size").cast("double")).alias("y"))
    q = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.array("p_retailprice").alias("x"))
    post = posterior.posterior(q, posterior.warp_observations(o, bounds), 10, 1.0, 0.1, scale=[100.0])
    return rounded(posterior.naturalize(post, bounds), *POST)


# ------------------------------------------------------------------ draws and hashes


def _mul(a: str, b: int) -> str:
    return f"((({a})::uhugeint * {b}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"


def _add(a: str, b: str) -> str:
    return f"((({a})::uhugeint + ({b})::uhugeint) % 18446744073709551616::uhugeint)::ubigint"


def splitmix_sql(source: str, key: str, out: str) -> str:
    """CTEs that add ``out``, the mix of the ubigint column ``key`` of ``source``."""
    return f"""{out}_a as (select *, {_add(key, str(0x9E3779B97F4A7C15))} as z0 from {source}),
{out}_b as (select * exclude (z0), {_mul('xor(z0, z0 >> 30)', 0xBF58476D1CE4E5B9)} as z1 from {out}_a),
{out}_c as (select * exclude (z1), {_mul('xor(z1, z1 >> 27)', 0x94D049BB133111EB)} as z2 from {out}_b),
{out}_t as (select * exclude (z2), xor(z2, z2 >> 31) as {out} from {out}_c)"""


def normal_sql(source: str, seed: str, row: str, metric: str) -> str:
    """CTEs ending in ``zt`` with the standard normal ``z`` of (seed, row, metric)."""
    key = _add(_mul(_add(_mul(seed, 1_000_003), row), 1_000_003), metric)
    return f"""key_t as (select *, {key} as k1, xor({key}, {0xD2B74407B1CE6E93}::ubigint) as k2 from {source}),
{splitmix_sql('key_t', 'k1', 'm1')}, {splitmix_sql('m1_t', 'k2', 'm2')},
zt as (select * exclude (k1, k2, m1, m2), sqrt(-2 * ln(greatest(1e-12, least(1 - 1e-12, (m1 >> 11)::double / 9007199254740992.0)))) * cos(2 * pi() * ((m2 >> 11)::double / 9007199254740992.0)) as z from m2_t)"""


@query(f"with src as (select event_id, user_id from events), {normal_sql('src', '7', 'event_id', '0')} select event_id, round(z, 6) as z from zt")
def normal_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(e.select("event_id", normal_column(F.lit(7), F.col("event_id"), F.lit(0)).alias("z")), "z")


@query(
    f"""with {NEAR}, w0 as (select qid, tid, y, d2, ys, 1 / (1e-9 + d2 + 0.1) as w, sd from r, s, (select unnest([3, 11]) as sd) where rk <= 10),
{normal_sql('w0', 'sd', 'tid', '0')}
select qid as query_id, 0 as metric, sd::bigint as seed, round(sum(w * y) / sum(w) + sqrt(greatest(1 / sum(w), 1e-9)) * max(ys) / greatest(sqrt(sum(w * w)) / sum(w), 1e-12) * sum(w * z) / sum(w), 6) as value from zt group by qid, sd"""
)
def function_draws(spark, sf_dir):
    return rounded(posterior.function_draws(*vectors(spark, sf_dir), 10, 1.0, 0.1, [3, 11]), "value")


# ------------------------------------------------------------------ fitting

LOO = """
u as (select qid, param_id, sum(w * y) / sum(w) as mu, sqrt(greatest(1 / sum(w) + sum(w * n) / sum(w), 1e-9)) * max(ys) as se, max(ys) as ys from (select x.*, param_id, ys, ale as n, 1 / (1e-9 + epi * d2 + ale) as w from x, p, s where rk <= k) group by qid, param_id)"""


@query(
    f"""with {NEAR}, p as (select unnest([0, 1, 2]) as param_id, 10 as k, unnest([1.0, 10.0, 0.1]::double[]) as epi, unnest([0.1, 1.0, 0.01]::double[]) as ale), {LOO}
select param_id, round(sum(-0.5 * ln(2 * pi() * (se / ys) * (se / ys)) - 0.5 * pow((label / ys - mu / ys) / (se / ys), 2)), 6) as loglik from u join embeddings on qid = vec_id group by param_id"""
)
def loo_loglik_params(spark, sf_dir):
    _, o = vectors(spark, sf_dir)
    params = spark.createDataFrame([(0, 10, 1.0, 0.1), (1, 10, 10.0, 1.0), (2, 10, 0.1, 0.01)], "param_id int, k int, epi double, ale double")
    return rounded(fit.subsample_loglik(o.where("row_id % 20 = 0"), o, params), "loglik")


CALIBRATED = f"""with {NEAR}, p as (select 0 as param_id, 10 as k, 1.0 as epi, 0.0 as ale), {LOO},
j as (select mu, label::double as y, se from u join embeddings on qid = vec_id),
l as (select regr_intercept(y, mu) as a, regr_slope(y, mu) as b from j)"""


@query(f"{CALIBRATED} select 0 as metric, round(max(a), 6) as a, round(max(b), 6) as b, round(sqrt(avg(pow(y - a - b * mu, 2))) / sqrt(avg(se * se)), 6) as c from j, l")
def affine_calibration(spark, sf_dir):
    _, o = vectors(spark, sf_dir)
    return rounded(fit.fit_affine(o.where("row_id % 20 = 0"), o, 10, 1.0, 0.0, observation_noise=True), "a", "b", "c")


@query(
    f"""{CALIBRATED}, c as (select max(a) as a, max(b) as b, sqrt(avg(pow(y - a - b * mu, 2))) / sqrt(avg(se * se)) as c from j, l),
v as ({moments_sql('r', ale=0.0).replace('round(', '(').replace(', 6)', ')')})
select query_id, metric, n_neighbors, round(a + b * mu, 6) as mu, round(sqrt(se_epi * c * se_epi * c + se_ale * c * se_ale * c), 6) as se, round(se_epi * c, 6) as se_epi, round(se_ale * c, 6) as se_ale from v, c"""
)
def calibrated_posterior(spark, sf_dir):
    """One search: the fit takes of its 11 neighbours those without the query itself, the posterior
    the first 10."""
    q, o = vectors(spark, sf_dir)
    near = posterior.neighbours(q, o, 11, False, None, "auto")
    c = fit.fit_affine(o.where("row_id % 20 = 0"), o, 10, 1.0, 0.0, observation_noise=True, near=knn.without_self(near, 10))
    # a limit that is a column leaves both branches the same exchange of the search
    params = spark.createDataFrame([(0, 10, 1.0, 0.0)], "param_id int, k int, epi double, ale double")
    return rounded(fit.apply_affine(posterior.batch_posterior(q, o, params, near=near).drop("param_id"), c), *POST)


@query(
    f"""with {NEAR}, p as (select 0 as param_id, 10 as k, 1.0 as epi, 0.1 as ale), {LOO}, j as (select mu, label::double as y, se, -0.5 * ln(2 * pi() * se * se) - 0.5 * pow((y - mu) / se, 2) as ll from u join embeddings on qid = vec_id)
select 0 as metric, round(-avg(ll), 6) as nll, round(sqrt(avg(pow(y - mu, 2))), 6) as rmse, round(avg(abs(y - mu)), 6) as mae, round(sqrt(avg(pow(y - mu, 2))) / stddev_pop(y), 6) as nrmse, round(avg(case when abs(y - mu) <= se then 1.0 else 0.0 end), 6) as within_one_se, round(avg(exp(ll)), 6) as mean_likelihood from j"""
)
def evaluation_metrics(spark, sf_dir):
    q, o = vectors(spark, sf_dir)
    post = posterior.posterior(q, o, 10, 1.0, 0.1, exclude_nearest=True, observation_noise=True)
    truth = o.select(F.col("row_id").alias("t"), F.col("y")[0].alias("y"))
    out = fit.evaluation(post.join(truth, F.col("query_id") == F.col("t")).select("metric", "y", "mu", "se"))
    return rounded(out, "nll", "rmse", "mae", "nrmse", "within_one_se", "mean_likelihood")


@query(
    """with p as (select count(*)::double as n, sum(value) as value from events group by event_type),
l as (select value, unnest(['ln_n', 'n', 'n2']) as term, unnest([ln(n), n, n * n]) as t from p)
select term, round(regr_intercept(value, t), 4) as intercept, round(regr_slope(value, t), 4) as slope, round(regr_r2(value, t), 4) as r2 from l group by term"""
)
def scaling_fit(spark, sf_dir):
    points = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("value"))
    return fit.scaling_fit(points).withColumns({c: F.round(F.col(c), 4) + 0.0 for c in ("intercept", "slope", "r2")})


# ------------------------------------------------------------------ dependence

LINES = """t as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as row_id, * from lineitem)"""
PART_X = """f as (select p_partkey as row_id, unnest([0, 1, 2]) as dim, unnest([p_size::double, p_retailprice, (p_partkey % 7)::double]) as v, (p_retailprice * (1 + p_size))::double as y from part)"""


def part_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    x = F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"), (F.col("p_partkey") % 7).cast("double"))
    return part.select(F.col("p_partkey").alias("row_id"), x.alias("x"), (F.col("p_retailprice") * (1 + F.col("p_size"))).cast("double").alias("y"))


RANKED = f"""{PART_X}, n as (select count(*) as n, avg(y) as m, var_pop(y) as vy from f where dim = 0),
k as (select dim, v, y, row_number() over (partition by dim order by v, row_id) - 1 as rk from f)"""
CELLS = f"with {RANKED}, g as (select dim, count(*) as c, sum(y - m) as t from k, n group by dim, floor(rk * greatest(floor(sqrt(n)), 2) / n)), h as (select dim, sum(t * t / c) as ssb from g group by dim), o as (select dim, n, vy * n as sst, ssb, greatest(floor(sqrt(n)), 2) as b from h, n), share as (select dim, n, greatest(ssb - (b - 1) * (sst - ssb) / (n - b), 0) / sst as share from o)"


@query(f"{CELLS} select dim, round(share, 6) as share from share")
def sobol_index(spark, sf_dir):
    return rounded(sobol.sobol_index(part_inputs(spark, sf_dir)), "share")


@query(f"with {RANKED}, g as (select dim, count(*) as c, avg(y) as a from k, n group by dim, floor(rk * 10 / n)) select dim, round(sum(c / n * pow(a - m, 2)) / max(vy), 6) as share from g, n group by dim")
def sobol_legacy(spark, sf_dir):
    return rounded(sobol.calculate_sobol_indices(part_inputs(spark, sf_dir)), "share")


@query(
    """with f as (select p_size, p_partkey % 7 as p7, (p_retailprice * (1 + p_size))::double as y from part), n as (select count(*) as n, avg(y) as m, var_pop(y) * count(*) as sst from f),
g as (select count(*) as c, sum(y - m) as t from f, n group by p_size, p7), h as (select sum(t * t / c) as ssb, count(*) as b from g)
select round(case when n < 2 * b then 0.0 else greatest(ssb - (b - 1) * (sst - ssb) / (n - b), 0) / sst end, 6) as share, b as cells from h, n"""
)
def group_sobol(spark, sf_dir):
    return rounded(sobol.group_sobol_index(part_inputs(spark, sf_dir), [0, 2]), "share")


@query(
    f"""{CELLS}, p as (select dim, case when share > 3 * sqrt(2.0 * (greatest(floor(sqrt(n)), 2) - 1)) / n then share else 0.0 end as s from share),
e as (select dim, case when (select max(s) from p) > 0 then greatest(s, 1e-6 * (select max(s) from p)) else 1.0 end as s from p), sp as (select dim, var_pop(v) as xv from f group by dim)
select e.dim, round((select count(*) from e) * s / (select sum(s) from e) / case when xv > 1e-12 then xv else 1.0 end, 6) as weight from e join sp using (dim)"""
)
def dependence_weights(spark, sf_dir):
    return rounded(sobol.dependence_weights(part_inputs(spark, sf_dir)), "weight")


@query(
    f"""with {LINES}, f as (select row_id, unnest([0, 1, 2]) as dim, unnest([l_quantity, l_discount, l_tax]::double[]) as v, l_extendedprice::double as y from t), n as (select count(*) as n, avg(y) as m, var_pop(y) as vy from f where dim = 0),
k as (select dim, y, row_number() over (partition by dim order by v + 0.0, y) - 1 as rk from f), g as (select dim, count(*) as c, avg(y) as a from k, n group by dim, floor(rk * 10 / n))
select dim, round(sum(c / n * pow(a - m, 2)) / max(vy), 6) as share from g, n group by dim"""
)
def sobol_lineitem(spark, sf_dir):
    """``lineitem`` has no key: equal inputs are ranked by the output, the same in every engine."""
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")])
    y = F.col("l_extendedprice").cast("double")
    return rounded(sobol.calculate_sobol_indices(table(spark, sf_dir, "lineitem").select(y.alias("row_id"), x.alias("x"), y.alias("y"))), "share")


@query("select round(median(value), 6) as center, round(stddev_pop(value), 6) as scale from events")
def standardize_y(spark, sf_dir):
    center, scale = expr.standardize(F.col("value"))
    return rounded(table(spark, sf_dir, "events").agg(center.alias("center"), scale.alias("scale")), "center", "scale")


# ------------------------------------------------------------------ streams and incumbents


@query("select event_type as key, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as scale, round(min(value), 6) as low, round(max(value), 6) as high from events group by event_type")
def running_moments(spark, sf_dir):
    """Moments of four arriving parts, merged one after the other."""
    e = table(spark, sf_dir, "events")
    state = ingest.moments(e.where("event_id % 4 = 0"), "event_type", "value")
    for k in range(1, 4):
        state = ingest.merge_moments(state, ingest.moments(e.where(f"event_id % 4 = {k}"), "event_type", "value"))
    return rounded(ingest.deviation(state).select("key", "n", "mean", "scale", "low", "high"), "mean", "scale", "low", "high")


@query("select c_custkey as row_id, round(c_acctbal, 6) as value from customer order by c_acctbal desc, c_custkey limit 25")
def incumbent_topm(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("value"))
    return rounded(fronts.top_m(c, 25, "value"), "value")


@query(
    """with a as (select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20), b as (select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 20)
select o_orderkey as row_id from (select * from a union select * from b)"""
)
def incumbents_two_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("date"))
    return fronts.incumbents(o, ["price", "date"], 20)


@query("select p_partkey as row_id from part where p_size = (select max(p_size) from part)")
def incumbents_with_ties(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").alias("size"))
    return fronts.incumbents(p, ["size"], 10)


# ------------------------------------------------------------------ fronts

FRONT = "(select p_partkey as id, p_size::double as a, -p_retailprice::double as b from part)"


def front_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), (-F.col("p_retailprice")).cast("double").alias("b"))


def front_sql(source: str) -> str:
    return f"select p.* from {source} p where not exists (select 1 from {source} o where o.a >= p.a and o.b >= p.b and (o.a > p.a or o.b > p.b))"


@query(f"with p as {FRONT} {front_sql('p')}")
def pareto_front(spark, sf_dir):
    return fronts.pareto_front(front_points(spark, sf_dir))


@query(
    f"with p0 as {FRONT}, f0 as ({front_sql('p0')}), p1 as (select * from p0 where id not in (select id from f0)), f1 as ({front_sql('p1')}), p2 as (select * from p1 where id not in (select id from f1)), f2 as ({front_sql('p2')})"
    " select *, 0 as layer from f0 union all select *, 1 from f1 union all select *, 2 from f2"
)
def pareto_layers(spark, sf_dir):
    return fronts.pareto_layers(front_points(spark, sf_dir), 3)


@query(
    f"with p as {FRONT}, u as (select distinct a, b from p where a > 0.0 and b > -2500.0), s as (select a, max(b) over (order by a desc, b desc) as best, coalesce(lead(a) over (order by a desc, b desc), 0.0) as nxt from u)"
    " select round(sum((a - nxt) * (best + 2500.0)), 6) as hypervolume from s"
)
def hypervolume(spark, sf_dir):
    return rounded(fronts.hypervolume(front_points(spark, sf_dir), (0.0, -2500.0)), "hypervolume")


@query(
    """with r as (select o_orderkey as row_id, o_totalprice::double as m0, epoch(o_orderdate::timestamp)::double as m1 from orders), g as (select min(m0) as a0, max(m0) as b0, min(m1) as a1, max(m1) as b1 from r)
select row_id, round(least((m0 - a0) / (b0 - a0) * 0.7, (m1 - a1) / (b1 - a1) * 0.3) + 0.05 * ((m0 - a0) / (b0 - a0) * 0.7 + (m1 - a1) / (b1 - a1) * 0.3), 6) as score from r, g"""
)
def scalarize(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").cast("double").alias("m0"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("m1"))
    return rounded(fronts.scalarize(o, ["m0", "m1"], [0.7, 0.3]), "score").select("row_id", "score")


@query(f"with {NEAR}, p as ({moments_sql('x', noise=True).replace('round(', '(').replace(', 6)', ')')}) select query_id, round(mu + 2.0 * se, 6) as ucb from p order by mu + 2.0 * se desc, query_id limit 8")
def ucb_topk(spark, sf_dir):
    post = posterior.posterior(*vectors(spark, sf_dir), 10, 1.0, 0.1, exclude_nearest=True, observation_noise=True)
    return rounded(posterior.upper_confidence(post, 2.0, 8), "ucb")


# ------------------------------------------------------------------ maps and objectives


@query(
    """select p_partkey, round((p_size - 1)::double / 49.0, 6) as u0, 0.5::double as u1, round(p_retailprice, 6) as back from part"""
)
def unit_cube(spark, sf_dir):
    bounds = [(1.0, 50.0), (3.0, 3.0), (0.0, 5000.0)]
    x = F.array(F.col("p_size").cast("double"), F.lit(3.0), F.col("p_retailprice").cast("double"))
    u = table(spark, sf_dir, "part").select("p_partkey", expr.to_unit(x, bounds).alias("u"))
    out = u.select("p_partkey", F.col("u")[0].alias("u0"), F.col("u")[1].alias("u1"), expr.from_unit(F.col("u"), bounds)[2].alias("back"))
    return rounded(out, "u0", "back")


@query(
    """select p_partkey, round(ln((p_size / 60.0) / (1 - p_size / 60.0)), 6) + 0.0 as both, round(ln(p_size - 0.5), 6) + 0.0 as lower, round(-ln(51.0 - p_size), 6) + 0.0 as upper, round(p_size::double, 6) as back,
round(60.0 * (p_size / 60.0) * (1 - p_size / 60.0), 6) as slope, round(pow(60.0 / (p_size * (60.0 - p_size)), 2) * 0.25, 6) as variance from part"""
)
def warp_roundtrip(spark, sf_dir):
    y, inf = F.col("p_size").cast("double"), expr.INF
    out = table(spark, sf_dir, "part").select(
        "p_partkey", expr.warp(y, 0.0, 60.0).alias("both"), expr.warp(y, 0.5, inf).alias("lower"), expr.warp(y, -inf, 51.0).alias("upper"),
        expr.unwarp(expr.warp(y, 0.0, 60.0), 0.0, 60.0).alias("back"), expr.unwarp_slope(expr.warp(y, 0.0, 60.0), 0.0, 60.0).alias("slope"), expr.warp_variance(F.lit(0.25), y, 0.0, 60.0).alias("variance"),
    )
    return rounded(out, "both", "lower", "upper", "back", "slope", "variance")


@query(
    """select p_partkey, round(least(greatest(p_size::double, 10 + greatest(0.001, 0.25 * p_partkey % 7)), 40 - greatest(0.001, 0.25 * p_partkey % 7)), 6) as mu,
round(case when 24.5 + greatest(0.001, 0.25 * (p_partkey % 7)) > 25.5 - greatest(0.001, 0.25 * (p_partkey % 7)) then 25.0::double else least(greatest(p_size::double, 24.5 + greatest(0.001, 0.25 * (p_partkey % 7))), 25.5 - greatest(0.001, 0.25 * (p_partkey % 7))) end, 6) as narrow from part""".replace("0.25 * p_partkey % 7", "0.25 * (p_partkey % 7)")
)
def project_mean(spark, sf_dir):
    mu, se = F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")
    out = table(spark, sf_dir, "part").select("p_partkey", expr.project(mu, se, 10.0, 40.0).alias("mu"), expr.project(mu, se, 24.5, 25.5).alias("narrow"))
    return rounded(out, "mu", "narrow")


ACK = "(-20 * exp(-0.2 * sqrt(({a}) / {n})) - exp(({b}) / {n}) + 20 + exp(1))"


def _ackley_sql(parts: list[str]) -> str:
    return ACK.format(a=" + ".join(f"({p} - 1) * ({p} - 1)" for p in parts), b=" + ".join(f"cos(2 * pi() * ({p} - 1))" for p in parts), n=len(parts))


@query(f"select p_partkey, round({_ackley_sql(['p_size / 10.0', 'p_retailprice / 1000.0', '0.5'])}, 6) as y, round(-{_ackley_sql(['p_size / 10.0', '0.5'])}, 6) as left_half, round(500000.0::double - 8.0::double * (p_size - 120.0::double) * (p_size - 120.0::double), 6) as s0, round(12.5::double - 110.0::double * (p_retailprice / 1000.0::double - 0.91::double) * (p_retailprice / 1000.0::double - 0.91::double), 6) as s1 from part")
def ackley(spark, sf_dir):
    a, b = F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0
    half, other = F.lit(0.5), F.col("p_size").cast("double")
    out = table(spark, sf_dir, "part").select("p_partkey", expr.ackley(F.array(a, b, half)).alias("y"), expr.double_ackley(F.array(a, half, b, half), 4)[0].alias("left_half"), expr.separable_unimodal(F.array(other, b)).alias("s"))
    return rounded(out.select("p_partkey", "y", "left_half", F.col("s")[0].alias("s0"), F.col("s")[1].alias("s1")), "y", "left_half", "s0", "s1")


@query(
    """with e as (select p_partkey, p_size / 25.0 - 1 as x from part), t as (select *, 1 / (1 + 0.3275911 * abs(x)) as t from e)
select p_partkey, round(sign(x) * (1 - (0.254829592 * t - 0.284496736 * t * t + 1.421413741 * t * t * t - 1.453152027 * t * t * t * t + 1.061405429 * t * t * t * t * t) * exp(-x * x)), 6) as erf from t"""
)
def erf(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", expr.erf(F.col("p_size") / 25.0 - 1).alias("erf")), "erf")


# ------------------------------------------------------------------ encoding


@query("select p_partkey, j::int as slot, case when j = p_partkey % 7 then 10.0 else 0.0 end::double as value from part, (select unnest(range(0, 7)) as j)")
def onehot(spark, sf_dir):
    code = encode.one_hot_column((F.col("p_partkey") % 7).cast("int"), 7)
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(code).alias("slot", "value"))


def id_hash_sql(source: str, ident: str, variable: int, seed: int, out: str) -> str:
    salt = (variable * 0x9E3779B97F4A7C15) % (1 << 64)
    return f"""{out}_a as (select *, xor(xor(({ident})::ubigint, {seed}::ubigint), {salt}::ubigint) as z0 from {source}),
{out}_b as (select * exclude (z0), {_mul('xor(z0, z0 >> 30)', 0xBF58476D1CE4E5B9)} as z1 from {out}_a),
{out}_c as (select * exclude (z1), {_mul('xor(z1, z1 >> 27)', 0x94D049BB133111EB)} as z2 from {out}_b),
{out}_t as (select * exclude (z2), xor(z2, z2 >> 31) as {out} from {out}_c)"""


@query(f"with src as (select p_partkey from part), {id_hash_sql('src', 'p_partkey', 0, 5, 'h')} select p_partkey, j::int as bit, round(case when (h >> j) & 1 = 1 then 10.0 / sqrt(8) else -10.0 / sqrt(8) end, 6) as value from h_t, (select unnest(range(0, 8)) as j)")
def sign_codes(spark, sf_dir):
    code = encode.sign_code_column(F.col("p_partkey"), 0, 8, 5)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", F.posexplode(code).alias("bit", "value")), "value")


@query(
    f"""with src as (select p_partkey, p_size from part), {id_hash_sql('src', 'p_partkey', 0, 0, 'h')}, {id_hash_sql('h_t', 'p_size', 1, 0, 'g')}
select p_partkey, j::int as bucket, round((case when h % 6 = j then case when h >> 63 = 1 then 1 else -1 end else 0 end + case when g % 6 = j then case when g >> 63 = 1 then 1 else -1 end else 0 end) / sqrt(2), 6) + 0.0 as value from g_t, (select unnest(range(0, 6)) as j)"""
)
def hash_features(spark, sf_dir):
    code = encode.hash_columns([F.col("p_partkey"), F.col("p_size")], 6)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", F.posexplode(code).alias("bucket", "value")), "value")


@query("select p_partkey as row_id, p_partkey % 25 as id from part")
def snap(spark, sf_dir):
    ids = np.arange(25)
    codes = spark.createDataFrame([(int(i), int(i), c.tolist()) for i, c in zip(ids, encode.sign_code(ids, 0, 16, 0, 10.0))], "id long, at long, code array<double>")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 25).alias("id"))
    encoded = part.select("row_id", F.transform(encode.sign_code_column(F.col("id"), 0, 16), lambda v: v * 0.9 + 0.05).alias("code"))
    return encode.snap_table(encoded, codes)


@query("select event_id, value from events order by md5('17:' || event_id::varchar), event_id limit 1000")
def reservoir(spark, sf_dir):
    """A uniform sample of 1000 events that any partitioning and order of arrival leaves the same."""
    return ingest.bottom_k(table(spark, sf_dir, "events"), "event_id", 1000, 17).select("event_id", "value")


def search_rows() -> list[tuple[int, int, float, float]]:
    return [(i, 10, float(e), float(a)) for i, (e, a) in enumerate(candidate_params(30, np.random.default_rng(0)))]


@query(
    f"""with {NEAR}, p as (select * from (values {', '.join(f"({i}, {k}, {e!r}::double, {a!r}::double)" for i, k, e, a in search_rows())}) v(param_id, k, epi, ale)), {LOO},
l as (select param_id, sum(-0.5 * ln(2 * pi() * (se / ys) * (se / ys)) - 0.5 * pow((label / ys - mu / ys) / (se / ys), 2)) as loglik from u join embeddings on qid = vec_id group by param_id)
select param_id, round(epi, 6) as epi, round(ale, 6) as ale, round(loglik, 6) as loglik from l join p using (param_id) order by l.loglik desc, param_id desc limit 1"""
)
def fit_search(spark, sf_dir):
    """The likeliest of 30 random scale pairs by the leave-one-out likelihood."""
    _, o = vectors(spark, sf_dir)
    rows = search_rows()
    params = spark.createDataFrame(rows, "param_id int, k int, epi double, ale double")
    loglik = fit.subsample_loglik(o.where("row_id % 20 = 0"), o, params)
    return rounded(fit.best_params(loglik).join(F.broadcast(params), "param_id").select("param_id", "epi", "ale", "loglik"), "epi", "ale", "loglik")


# ------------------------------------------------------------------ more of the model


@query(
    f"""with q as (select vec_id as qid from embeddings where vec_id % 20 = 0)
select qid as query_id, 0 as metric, 0.0::double as mu, 1.0::double as se from q"""
)
def prior(spark, sf_dir):
    """A model without rows answers with its prior."""
    q, o = vectors(spark, sf_dir)
    none = posterior.posterior(q, o.where("false"), 10, 1.0, 0.1)
    return rounded(posterior.with_prior(none, q, 1).select("query_id", "metric", "mu", "se"), "mu", "se")


FEW = NEAR.replace("yvar from embeddings)", "yvar from embeddings where vec_id < 12)")


@query(f"with {FEW} {moments_sql('x', k='11')}")
def usable_k(spark, sf_dir):
    """Of 12 rows a stored query has 11 others: then no query of the batch uses more."""
    q, o = vectors(spark, sf_dir)
    return rounded(posterior.posterior(q, o.where("row_id < 12"), 12, 1.0, 0.1, exclude_nearest=True, strict_batch_k=True), *POST)


@query(f"with src as (select event_id from events), {normal_sql('src', '7', 'event_id', str(0xC0FFEE00D15CA11E))} select event_id, round(z, 6) as z from zt")
def query_noise_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(e.select("event_id", query_normal_column(F.lit(7), F.col("event_id"), F.lit(0)).alias("z")), "z")
