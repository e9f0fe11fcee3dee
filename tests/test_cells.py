"""The cell index: equal to the search over all rows, whatever is inserted, split or rescaled."""

import numpy as np
import pytest

import nearfield as nf
from nearfield.operators.knn import knn, recall
from nearfield.plans import settings
from nearfield.sources.cells import CellIndex


def frame(spark, x, name="row_id", start=0):
    return spark.createDataFrame([(start + i, v) for i, v in enumerate(np.asarray(x).tolist())], f"{name} long, x array<double>")


def rows(df):
    return [tuple(r) for r in df.select("query_id", "rank", "row_id", "d2").orderBy("query_id", "rank").collect()]


@pytest.fixture(scope="module")
def points():
    """Clouds of different width, and one point that a third of all rows share."""
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(size=(700, 3)), np.zeros((500, 3)), 5 + 0.1 * rng.normal(size=(300, 3))])


def test_equal_to_the_whole_search(spark, points, tmp_path):
    o, q = frame(spark, points), frame(spark, points[::100], "query_id")
    index = CellIndex.build(o, str(tmp_path / "i"), cell_rows=64)
    assert index.n == len(points) and len(index.leaves) > 10
    assert all(leaf.n <= 64 or leaf.radius == 0 for leaf in index.leaves.values())
    for options in ({}, {"exclude_self": True}, {"scale": [1.0, 2.0, 0.25]}):
        assert rows(index.knn(q, 6, **options)) == rows(knn(q, o, 6, **options))
    index.knn(frame(spark, points[-1:], "query_id"), 6).collect()
    assert 0 < index.rows_read < len(points) / 2  # a query in a narrow cloud reads little


def test_insert_split_reopen_rebuild(spark, points, tmp_path):
    o, q = frame(spark, points), frame(spark, points[::150], "query_id")
    index = CellIndex.build(o.where("row_id < 800"), str(tmp_path / "i"), cell_rows=64)
    assert rows(index.knn(q, 5, pending=o.where("row_id >= 800"))) == rows(knn(q, o, 5))
    before = set(index.leaves)
    index.insert(o.where("row_id >= 800"))
    assert before - set(index.leaves), "an overfull leaf is split"
    again = CellIndex.open(spark, str(tmp_path / "i"))
    assert again.n == len(points) and rows(again.knn(q, 5)) == rows(knn(q, o, 5))
    assert sorted(r["row_id"] for r in again.rows().collect()) == list(range(len(points)))
    again.rebuild([1.0, 4.0, 1.0])
    assert rows(again.knn(q, 5, scale=[1.0, 4.0, 1.0])) == rows(knn(q, o, 5, scale=[1.0, 4.0, 1.0]))


def test_budget_and_edges(spark, points, tmp_path):
    o, q = frame(spark, points), frame(spark, points[::50], "query_id")
    index = CellIndex.build(o, str(tmp_path / "i"), cell_rows=64)
    assert recall(index.knn(q, 5, budget=6), knn(q, o, 5)).first()[0] > 0.9
    assert rows(index.knn(q, 0)) == [] and rows(index.knn(q.limit(0), 3)) == []
    assert rows(index.knn(q.limit(1), 2000))[-1][1] == len(points)
    with pytest.raises(ValueError):
        index.knn(q, -1)
    empty = CellIndex.build(o.limit(0), str(tmp_path / "e"))
    assert rows(empty.knn(q, 3)) == []
    empty.insert(o.limit(30))
    assert rows(empty.knn(q, 3)) == rows(knn(q, o.limit(30), 3))
    assert CellIndex.open(spark, str(tmp_path / "none")) is None


def test_model_searches_through_its_index(spark, points, tmp_path):
    y = points[:, :1] + 1.0
    params, seeds = nf.ENNParams(5, 1.0, 0.1), [1, 2]
    with nf.EpistemicNearestNeighbors(points[:1200], y[:1200], work_dir=tmp_path / "m", spark=spark) as m:
        before = m.posterior(points[::200], params=params)
        drawn, ids = m.posterior_function_draw(points[::200], params=params, function_seeds=seeds)
        m.ensure_index_sync()
        assert m.num_indexed == 1200 and m.index_memory_bytes() > 0
        after = m.posterior(points[::200], params=params)
        np.testing.assert_allclose(after.mu, before.mu, rtol=1e-12)
        np.testing.assert_array_equal(after.idx, before.idx)
        again, ids2 = m.posterior_function_draw(points[::200], params=params, function_seeds=seeds)
        np.testing.assert_allclose(again, drawn, rtol=1e-9)
        np.testing.assert_array_equal(ids, ids2)
        m.add(points[1200:], y[1200:])
        np.testing.assert_array_equal(m.neighbors(points[-1:], 1), [[len(points) - 1]])
    m = nf.EpistemicNearestNeighbors.open(tmp_path / "m", spark)
    assert m.num_indexed == 1200
    m.persist_index_to_disk()
    assert m.num_indexed == len(points)
    m.store.clear()
    assert not m.store.files.exists(m.store.index_path)
    m.close()


def test_appends_keep_an_index(spark, points, tmp_path):
    for name, value in (("min_rows", 300), ("cell_rows", 64)):
        spark.conf.set(f"spark.nearfield.index.{name}", value)
    try:
        with nf.EpistemicNearestNeighbors(points[:200], points[:200, :1], work_dir=tmp_path / "m", spark=spark) as m:
            assert m.num_indexed == 0
            m.add(points[200:500], points[200:500, :1])
            m.add(points[500:510], points[500:510, :1])
            assert m.num_indexed == 500 and len(m) == 510
        spark.conf.set("spark.nearfield.index.max_dim", 2)
        with nf.EpistemicNearestNeighbors(points[:400], points[:400, :1], work_dir=tmp_path / "wide", spark=spark) as m:
            assert m.num_indexed == 0
    finally:
        for name in ("min_rows", "cell_rows", "max_dim"):
            spark.conf.unset(f"spark.nearfield.index.{name}")


def test_strict_batch_k(spark, tmp_path):
    x = np.arange(6.0)[:, None]
    with nf.EpistemicNearestNeighbors(x, x, work_dir=tmp_path / "m", spark=spark) as m:
        q, leave = np.array([[2.0], [2.5]]), nf.PosteriorFlags(True, False)
        params = nf.ENNParams(6, 1.0, 0.1)
        assert (m.posterior(q, params=params, flags=leave).idx >= 0).sum(axis=1).tolist() == [5, 6]
        strict = m.posterior(q, params=params, flags=leave, strict_batch_k=True)
        np.testing.assert_allclose(strict.mu[1], m.posterior(q[1:], params=nf.ENNParams(5, 1.0, 0.1)).mu[0], rtol=1e-12)
        both = m.batch_posterior(q, paramss=[params], flags=leave, strict_batch_k=True)
        np.testing.assert_allclose(both.mu[0], strict.mu, rtol=1e-12)


def test_settings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(settings, "_PATH", settings.config_path())
    settings.set_config_path(tmp_path / "a" / "config.toml")
    assert settings.Settings.load(spark) == settings.Settings()
    settings.ensure_config_file()
    assert settings.Settings.load(spark) == settings.Settings()
    (tmp_path / "a" / "config.toml").write_text("[index]\ncell_rows = 12\nmin_rows = -3\nstretch = 'wide'\n")
    assert settings.Settings.load(spark) == settings.Settings(index_cell_rows=12)
    spark.conf.set("spark.nearfield.index.cell_rows", "99")
    assert settings.Settings.load(spark).index_cell_rows == 99
    spark.conf.unset("spark.nearfield.index.cell_rows")
    (tmp_path / "a" / "config.toml").write_text("not toml [")
    assert settings.Settings.load(spark) == settings.Settings()


def test_overrides():
    base = nf.turbo_enn_config(enn=nf.ENNSurrogateConfig(k=5, fit=nf.ENNFitConfig(num_fit_samples=5)))
    new = nf.with_overrides(base, {"acquisition": "ucb", "min_candidates": 3, "length_init": 0.5, "noise_aware": True, "num_fit_candidates": 7, "raasp_fast": True, "candidate_rv": "sobol", "alpha": None})
    assert (new.candidates.min_candidates, new.trust_region.length_init, new.trust_region.noise_aware) == (3, 0.5, True)
    assert new.surrogate.num_fit_candidates == 7 and new.candidate_rv is nf.CandidateRV.SOBOL and new.raasp_driver is nf.RAASPDriver.FAST
    several = nf.with_overrides(base, {"num_metrics": 3, "alpha": 0.1, "rescalarize": "on_propose"}).trust_region
    assert (several.num_metrics, several.alpha, several.rescalarize) == (3, 0.1, nf.Rescalarize.ON_PROPOSE)
    assert nf.with_overrides(base, {"freeze_params": True}).surrogate.num_fit_samples is None
    assert isinstance(nf.with_overrides(base, {"trust_region": "none"}).trust_region, nf.NoTRConfig)
    for wrong in ({"nothing": 1}, {"trust_region": "none", "length_min": 0.1}, {"trust_region": "turbo", "alpha": 0.1}, {"rescalarize": "on_restart"}, {"acquisition": "best"}):
        with pytest.raises(ValueError):
            nf.with_overrides(base, wrong)
    with pytest.raises(ValueError):
        nf.with_overrides(nf.turbo_zero_config(), {"weighting": True})


def test_generator_of_given_state_and_thompson():
    from nearfield.functions.random_hash import NumpyNormal
    from nearfield.plans.statistics import gaussian_thompson

    state = np.random.PCG64(5).state["state"]
    halves = [v for n in ("state", "inc") for v in (state[n] >> 64, state[n] & (2**64 - 1))]
    one = NumpyNormal(*halves)
    np.testing.assert_array_equal(np.concatenate([one.standard_normals(3), one.standard_normals(2)]), np.random.default_rng(5).standard_normal(5))
    rng = np.random.default_rng(0)
    assert gaussian_thompson([0.0, 9.0, 5.0], [0, 0, 0], 2, rng).tolist() == [1, 2]
    assert sorted(gaussian_thompson(np.zeros(4), np.ones(4), 9, rng)) == [0, 1, 2, 3] and not len(gaussian_thompson([1.0], [1.0], 0, rng))
    with pytest.raises(ValueError):
        gaussian_thompson([], [], 1, rng)


def test_policy_over_a_model(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.random((40, 2))
    with nf.EpistemicNearestNeighbors(x, x[:, :1], work_dir=tmp_path / "m", spark=spark, weighting=True) as m:
        policy = nf.MetricPolicy(m, refit_growth=3.0, reservoir_capacity=30, seed=None)
        assert policy.refit_growth == 3.0 and policy.num_seen == 40
        policy.set_weights([4.0, 1.0])
        np.testing.assert_allclose(m.x_scale_row, [0.5, 1.0])
        with pytest.raises(ValueError):
            nf.MetricPolicy(m, refit_growth=0.5)
        with pytest.raises(ValueError):
            nf.MetricPolicy(m, colour=1)
    with nf.EpistemicNearestNeighbors.open(tmp_path / "m", spark) as m:
        assert m.metric.refit_growth == 3.0 and m.metric.weights.tolist() == [4.0, 1.0]
