"""The model over a store: shapes, contracts, invariances, durability."""

import numpy as np
import pytest

import nearfield as nf
from nearfield.functions import random_hash
from nearfield.functions.numeric import erf_approx, ndtri, standardize_y, z_crit
from nearfield.operators.knn import knn
from nearfield.plans import statistics as st
from nearfield.plans.fitter import subsample_loglik

CORNERS = np.array([[0.0, 0], [1, 0], [0, 1], [1, 1]])
VALUES = np.array([[0.0], [1], [1], [2]])
MIDDLE = np.array([[0.5, 0.5]])


@pytest.fixture
def make(spark, tmp_path):
    made = []

    def build(x, y, yvar=None, **options):
        m = nf.EpistemicNearestNeighbors(x, y, yvar, work_dir=tmp_path / f"m{len(made)}", spark=spark, **options)
        made.append(m)
        return m

    yield build
    for m in made:
        m.close()


def brute(model_x, model_y, q, k, epi, ale, yvar=None, noise=False):
    s = model_y.std(axis=0)
    s = np.where(s > 0, s, 1)
    out = []
    for row in q:
        d2 = ((model_x - row) ** 2).sum(axis=1)
        at = np.lexsort((np.arange(len(d2)), d2))[:k]
        v = ale + (0 if yvar is None else yvar[at] / s**2) * np.ones((len(at), model_y.shape[1]))
        w = 1 / (1e-9 + epi * d2[at, None] + v)
        mean = (w * model_y[at]).sum(axis=0) / w.sum(axis=0)
        a = (w * v).sum(axis=0) / w.sum(axis=0) if noise else 0
        out.append((mean, np.sqrt(np.maximum(1 / w.sum(axis=0) + a, 1e-9)) * s))
    return np.array([o[0] for o in out]), np.array([o[1] for o in out])


def test_public_names():
    assert len(nf.__all__) == 35 and all(getattr(nf, n) is not None for n in nf.__all__)
    with pytest.raises(AttributeError):
        nf.no_such_name


def test_posterior_against_numpy(make):
    rng = np.random.default_rng(0)
    x, y, v, q = rng.normal(size=(60, 3)), rng.normal(size=(60, 2)), rng.random((60, 2)), rng.normal(size=(7, 3))
    m = make(x, y, v)
    for noise in (False, True):
        post = m.posterior(q, params=nf.ENNParams(5, 0.7, 0.2), flags=nf.PosteriorFlags(False, noise))
        mu, se = brute(x, y, q, 5, 0.7, 0.2, v, noise)
        np.testing.assert_allclose(post.mu, mu, rtol=1e-9)
        np.testing.assert_allclose(post.se, se, rtol=1e-9)
        np.testing.assert_allclose(np.hypot(post.se_epi, post.se_ale), post.se, rtol=1e-9)
        assert post.idx.shape == (7, 5)


def test_function_draw_golden(make):
    m = make(CORNERS, VALUES)
    draws, idx = m.posterior_function_draw(MIDDLE, params=nf.ENNParams(2, 1.0, 0.1), function_seeds=[7])
    assert draws.shape == (1, 1, 1) and idx.tolist() == [[0, 1]]
    assert draws[0, 0, 0] == pytest.approx(0.22380617957221643, abs=1e-12)


def test_philox_goldens():
    want = [0.19429564658481888, 0.7494216283833375, 0.2715516953434825, 0.807575439532017, 1.909158222295347, -1.2695907667419593, 0.6468060655233859, 1.965987039301151]
    got = random_hash.normal_hash_batch_multi_seed([1, 7], [0, 4, 4], 2)
    assert got.shape == (2, 3, 2) and (got[:, 1] == got[:, 2]).all()
    np.testing.assert_allclose(got[:, :2].ravel(), want, atol=1e-12)
    with pytest.raises(ValueError):
        random_hash.normal_hash_batch_multi_seed_fast([1], [0], 0)
    z = random_hash.normal_hash_batch_multi_seed_fast(np.arange(200), np.arange(100), 1)
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03


def test_conditional_and_batch(make):
    m = make(CORNERS, VALUES)
    p = nf.ENNParams(2, 1.0, 0.1)
    plain = m.posterior(MIDDLE, params=p)
    same = m.conditional_posterior(np.zeros((0, 2)), np.zeros((0, 1)), MIDDLE, params=p)
    np.testing.assert_allclose(same.mu, plain.mu, rtol=1e-12)
    np.testing.assert_allclose(same.se, plain.se, rtol=1e-12)
    batch = m.batch_posterior(MIDDLE, paramss=[p, nf.ENNParams(4, 2.0, 0.0)])
    assert batch.mu.shape == (2, 1, 1) and batch.idx is None
    np.testing.assert_allclose(batch.mu[0], plain.mu)
    mu, se = brute(np.r_[CORNERS, [[0.4, 0.4]]], np.r_[VALUES, [[5.0]]], MIDDLE, 2, 1.0, 0.1)
    cond = m.conditional_posterior([[0.4, 0.4]], [[5.0]], MIDDLE, params=p)
    np.testing.assert_allclose(cond.mu, mu)
    np.testing.assert_allclose(cond.se, se)
    assert 4 in cond.idx
    with pytest.raises(ValueError):
        m.batch_posterior(MIDDLE, paramss=[])


def test_empty_model_is_the_prior(make):
    m = make(np.zeros((0, 3)), np.zeros((0, 1)))
    post = m.posterior(np.zeros((2, 3)), params=nf.ENNParams(3))
    assert post.mu.tolist() == [[0], [0]] and post.se.tolist() == [[1], [1]] and post.idx.shape == (2, 0)
    assert m.neighbors(np.zeros((2, 3)), 4).shape == (2, 0)
    m.add([[0.0, 0, 0]], [[1.0]])
    assert len(m) == 1 and m.y_scale_row.tolist() == [1]


def test_exclusion(make):
    x = np.r_[CORNERS, [[10.0, 10.0]]]
    m = make(x, np.arange(5.0)[:, None])
    assert m.neighbors(x[:1], 2, exclude_nearest=True).tolist() == [[1, 2]]
    assert m.neighbors([[10.1, 10.1]], 2, exclude_nearest=True).tolist() == [[4, 3]]
    one = make(CORNERS[:1], VALUES[:1])
    with pytest.raises(ValueError):
        one.neighbors(CORNERS, 1, exclude_nearest=True)
    with pytest.raises(ValueError):
        m.neighbors(CORNERS, -1)


def test_invariances(make):
    rng = np.random.default_rng(1)
    x, y, q, p = rng.normal(size=(30, 2)), rng.normal(size=(30, 1)), rng.normal(size=(4, 2)), nf.ENNParams(5, 1.0, 0.1)
    a, b, c = make(x, y), make(x, 100 * y), make(x, y + 1000)
    pa, pb, pc = (m.posterior(q, params=p) for m in (a, b, c))
    np.testing.assert_allclose(pb.mu, 100 * pa.mu, rtol=1e-9)
    np.testing.assert_allclose(pb.se, 100 * pa.se, rtol=1e-9)
    np.testing.assert_allclose(pc.mu, pa.mu + 1000, rtol=1e-9)
    np.testing.assert_allclose(pc.se, pa.se, rtol=1e-6)


def test_incremental_equals_fresh(make):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(15, 3)), rng.normal(size=(15, 1)) * np.r_[np.ones(10), 100 * np.ones(5)][:, None]
    a, b = make(x[:10], y[:10]), make(x, y)
    a.add(x[10:], y[10:])
    p = nf.ENNParams(4, 1.0, 0.1)
    np.testing.assert_allclose(a.posterior(x, params=p).se, b.posterior(x, params=p).se, rtol=1e-12)


def test_bounded_outputs(make):
    rng = np.random.default_rng(3)
    x = rng.random((40, 1))
    y = np.exp(np.sin(6 * x))
    m = make(x, y, y_bounds=[[0.0, np.inf]])
    post = m.posterior(x[:5], params=nf.ENNParams(5, 1.0, 0.1))
    lo, hi = post.confidence_interval(0.99)
    assert (post.mu > 0).all() and (lo > 0).all() and (lo < post.mu).all() and (hi > post.mu).all()
    assert post.sample(50, 0).shape == (5, 1, 50) and (post.sample(50, 0) > 0).all()
    back = m.train_rows_at([3, 0, 3])
    np.testing.assert_array_equal(back[1], y[[3, 0, 3]])
    with pytest.raises(ValueError):
        m.add([[0.1]], [[-1.0]])
    assert len(m) == 40


def test_store_life(make, spark, tmp_path):
    m = make(CORNERS, VALUES)
    path = tmp_path / "m0"
    with pytest.raises(ValueError, match="already open"):
        nf.EpistemicNearestNeighbors.open(path, spark)
    with pytest.raises(ValueError):
        nf.EpistemicNearestNeighbors(CORNERS, VALUES, work_dir=path, spark=spark)
    before = m.posterior(MIDDLE, params=nf.ENNParams(3, 1.0, 0.1))
    m.add([[2.0, 2.0]], [[7.0]])
    m.store.compact(2)
    m.close()
    with nf.EpistemicNearestNeighbors.open(path, spark) as again:
        assert len(again) == 5 and again.index_memory_bytes() > 0
        assert again.train_rows_at([4])[1].tolist() == [[7.0]]
        np.testing.assert_allclose(again.posterior(MIDDLE, params=nf.ENNParams(3, 1.0, 0.1)).mu, before.mu)
        with pytest.raises(ValueError):
            again.train_rows_at([5])
    with pytest.raises(ValueError):
        nf.EpistemicNearestNeighbors(CORNERS, VALUES, work_dir=" ", spark=spark)


def test_bad_rows(make):
    for x, y, v in ((CORNERS[0], VALUES, None), (CORNERS, VALUES[:, 0], None), (CORNERS, VALUES[:3], None), (CORNERS * np.nan, VALUES, None), (CORNERS, VALUES, -VALUES - 1), (CORNERS, VALUES, np.ones((4, 2)))):
        with pytest.raises(ValueError):
            make(x, y, v)
    m = make(CORNERS, VALUES, 0.1 + VALUES)
    for args in ((CORNERS, VALUES), (CORNERS[:, :1], VALUES, VALUES)):
        with pytest.raises(ValueError):
            m.add(*args)
    with pytest.raises(ValueError):
        m.posterior([[np.inf, 0]], params=nf.ENNParams(1))
    for bad in ((0, 1, 1), (1, -1, 1), (1, np.nan, 1)):
        with pytest.raises(ValueError):
            nf.ENNParams(*bad)


def test_strategies_agree(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (300, 3)).astype(float)  # many ties
    o = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, x array<double>").repartition(5)
    q = o.where("row_id % 9 = 0").withColumnRenamed("row_id", "query_id")
    for exclude in (False, True):
        rows = [sorted(map(tuple, knn(q, o, 7, exclude_self=exclude, strategy=s, scale=[1.0, 2.0, 0.5]).collect())) for s in ("sql", "block", "grid")]
        assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 34 * 7


def test_scalars():
    assert ndtri(0) == -np.inf and np.isnan(ndtri(2)) and ndtri(0.975) == pytest.approx(1.959963984540054)
    assert z_crit(0.95) == pytest.approx(1.95996, abs=1e-4) and erf_approx(0.5) == pytest.approx(0.5204999, abs=2e-7)
    assert standardize_y([1, 2, 6])[0] == 2 and standardize_y([])[1] == 1 and standardize_y([3, 3]) == (3, 1)


def test_fitting_and_calibration(make):
    rng = np.random.default_rng(5)
    x = rng.random((80, 2))
    y = np.sin(6 * x[:, :1]) + 0.1 * rng.standard_normal((80, 1))
    m = make(x, y)
    few = [nf.ENNParams(5, 1.0, 0.1), nf.ENNParams(5, 1e-3, 1e-6)]
    good, bad = subsample_loglik(m, x, y, paramss=few, P=80, seed=0)
    assert good != bad and np.isfinite(good)
    fitter = nf.ENNStatefulFitter(5, seed=0)
    p = fitter.ask(m, num_fit_candidates=10, num_fit_samples=20, affine_calibrate=True)
    assert p.k_num_neighbors == 5 and p.calibrator is not None
    best = subsample_loglik(m, x, y, paramss=[p], P=80, seed=0)[0]
    assert best > bad
    again = nf.ENNStatefulFitter(5, seed=0).ask(m, num_fit_candidates=10, num_fit_samples=20)
    assert (again.epistemic_variance_scale, again.aleatoric_variance_scale) == (p.epistemic_variance_scale, p.aleatoric_variance_scale)
    raw = m.posterior(x[:3], params=nf.ENNParams(5, 1, 0.1))
    cal = nf.AffineCalibrator([1.0], [2.0], [3.0])
    done = m.posterior(x[:3], params=nf.ENNParams(5, 1, 0.1, cal))
    np.testing.assert_allclose(done.mu, 1 + 2 * raw.mu)
    np.testing.assert_allclose(done.se, 3 * raw.se)
    line = nf.AffineCalibrator.fit([0.0, 1, 2], [1.0, 3, 5], [1.0, 1, 1])
    assert (line.a[0], line.b[0], line.c[0]) == pytest.approx((1, 2, 0))
    draws = rng.normal(size=(3, 1, 4))
    np.testing.assert_allclose(cal.map_draws(draws, raw.mu), 1 + 2 * raw.mu[..., None] + 3 * (draws - raw.mu[..., None]))


def test_statistics_on_fixed_stream():
    n, d = 120, 3
    i, j = np.arange(n)[:, None], np.arange(d)[None]
    x = ((i + 1) * (j + 3) * 0.017 + 0.001 * i) % 1.0
    y = np.sin(6 * np.pi * x[:, 0]) + 0.01 * x[:, 1]
    w, gain = st.auto_weights(x, y, 10)
    assert w[0] == pytest.approx(35.3195787, rel=1e-6) and w[1:] == pytest.approx([3.58123e-5, 3.58718e-5], rel=1e-4)
    assert gain == pytest.approx(1.587039, abs=3e-3)
    ones, none = st.auto_weights(x[:50], y[:50], 10)
    assert ones.tolist() == [1, 1, 1] and none == -np.inf


def test_frames_agree_with_arrays(spark):
    from nearfield.operators import sobol

    rng = np.random.default_rng(6)
    x = np.c_[rng.random(400), rng.integers(0, 4, 400), rng.integers(0, 3, 400)]
    y = np.sin(5 * x[:, 0]) + 0.5 * x[:, 1] * x[:, 2] + 0.1 * rng.random(400)
    t = spark.createDataFrame([(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y))], "row_id long, x array<double>, y double").repartition(4)
    both = lambda df: [r[1] for r in sorted(df.collect())]
    np.testing.assert_allclose(both(sobol.sobol_index(t)), st.sobol_index(x, y), atol=1e-9)
    np.testing.assert_allclose(both(sobol.calculate_sobol_indices(t)), st.calculate_sobol_indices(x, y), atol=1e-9)
    assert sobol.group_sobol_index(t, [1, 2]).first()["share"] == pytest.approx(st.group_sobol_index(x[:, 1:], y))
    np.testing.assert_allclose(both(sobol.dependence_weights(t, tied=[[1, 2]])), st.dependence_weights(x, y, tied=[[1, 2]]), rtol=1e-9)


def test_fronts():
    a, b = np.array([1.0, 2, 2, 0, 1]), np.array([3.0, 1, 1, 4, 2])
    assert st.pareto_front_2d_maximize(a, b).tolist() == [1, 2, 0, 3]
    assert st.hypervolume_2d_max([[1, 0.5], [0.5, 1]], [0, 0]) == pytest.approx(0.75)
    assert st.hypervolume_2d_max(np.zeros((0, 2)), [0, 0]) == 0 and st.hypervolume_2d_max([[-1, -1]], [0, 0]) == 0
    for bad in (([[1, 2, 3]], [0, 0]), ([[1, 2]], [0])):
        with pytest.raises(ValueError):
            st.hypervolume_2d_max(*bad)
    assert st.arms_from_pareto_fronts(None, [1, 1, 2], [0.01, 10, 1.5], 1, 0).tolist() in ([1], [2])
    assert st.arms_from_pareto_fronts(None, [1, 1, 2], [0.01, 10, 1.5], 3, 0).tolist()[0] == 2


def test_reservoir_is_uniform():
    hits = np.zeros(40)
    for seed in range(300):
        r = st.Reservoir(8, 1, seed)
        for k in range(0, 40, 5):
            r.add(np.arange(k, k + 5)[:, None], np.zeros(5))
        hits[r.x[:, 0].astype(int)] += 1
    assert r.num_seen == 40 and len(r) == 8
    assert abs(hits / 300 - 0.2).max() < 0.09


def test_weighting_learns(make):
    rng = np.random.default_rng(7)
    x = rng.random((130, 4))
    y = np.sin(6 * x[:, :1])
    m = make(x[:90], y[:90], weighting=True)
    assert m.metric.num_refits == 0 and m.x_scale_row.tolist() == [1] * 4
    m.add(x[90:], y[90:])
    assert m.metric.num_refits == 1 and m.metric.uses_learned and m.metric.weights[0] == max(m.metric.weights)
    weights = m.metric.weights.copy()
    m.close()
    again = nf.EpistemicNearestNeighbors.open(m.store.path, m.spark)
    assert again.metric.weights.tolist() == weights.tolist() and again.metric.num_seen == 130
    again.close()


def test_distances_are_padded(make):
    m = make(CORNERS[:2], VALUES[:2])
    d2, ids = m.neighbor_distances_and_indices([[0.0, 0.0]], 4)
    assert d2.tolist() == [[0.0, 1.0, np.inf, np.inf]] and ids.tolist() == [[0, 1, 1, 1]]
    assert m.neighbor_distances_and_indices([[0.0, 0.0]], 3, pad_with_last=False)[1].tolist() == [[0, 1, -1]]


def test_one_short_query_can_shorten_all(spark):
    from nearfield.operators.posterior import posterior

    rows = [(i, [i + 0.1 * j for j in range(2)], [float(i)], [0.01]) for i in range(10)]
    o = spark.createDataFrame(rows, "row_id long, x array<double>, y array<double>, yvar array<double>")
    q = spark.createDataFrame([(i, [i + 0.1 * j for j in range(2)]) for i in range(5)] + [(100 + i, [100.0 + i, 100.1 + i]) for i in range(5)], "query_id long, x array<double>")
    counts = lambda **k: {r["n_neighbors"] for r in posterior(q, o, 10, exclude_nearest=True, **k).collect()}
    assert counts() == {9, 10} and counts(strict_batch_k=True) == {9}


def test_store_survives_a_stop_at_any_step(spark, tmp_path, monkeypatch):
    from nearfield.sources.store import Files, ObservationStore

    path = str(tmp_path / "store")
    store = ObservationStore.create(spark, path, 2, 1)
    store.commit()
    x = np.arange(20.0).reshape(10, 2)
    store.append_arrays(x, x[:, :1])
    store.append_arrays(x + 1, x[:, :1])

    def stopped(*_):
        raise KeyboardInterrupt

    for step in ("replace", "delete"):  # before the commit of a compaction, and after it
        with monkeypatch.context() as m:
            m.setattr(Files, step, stopped)
            with pytest.raises(KeyboardInterrupt):
                store.compact(1)
        again = ObservationStore.open(spark, path, lock=False)
        assert again.rows().count() == again.identity["num_obs"] == store.rows().count() == 20
    assert again.identity["batches"] == 1
    with monkeypatch.context() as m:
        m.setattr(Files, "replace", stopped)
        with pytest.raises(KeyboardInterrupt):
            store.append_arrays(x, x[:, :1])
        with pytest.raises(KeyboardInterrupt):
            store.clear()
    assert store.identity["num_obs"] == 20
    assert store.append_arrays(x + 2, x[:, :1]) == 10 and store.rows().count() == 30
    assert ObservationStore.open(spark, path, lock=False).rows().where("row_id >= 20").count() == 10
    store.close()


def test_moments_do_not_cancel(spark):
    from nearfield.streaming import ingest

    rows = spark.range(1000).selectExpr("'k' as k", "1e9 + id % 7 as v", "id")
    both = ingest.merge_moments(ingest.moments(rows.where("id < 300"), "k", "v"), ingest.moments(rows.where("id >= 300"), "k", "v")).first()
    assert both["m2"] == pytest.approx(np.var([k % 7 for k in range(1000)]) * 1000, rel=1e-6)
