"""Configurations, regions, candidates, the ask/tell loop, encoders, streams."""

import numpy as np
import pytest

import nearfield as nf
from nearfield import benchmarks
from nearfield.operators.encode import column_plan, log_code_width, sign_code
from nearfield.plans import candidates as gen
from nearfield.plans import config as cfg
from nearfield.plans.region import MorboRegion, Region, WholeBox, scalarized

BOX = np.array([[-2.0, 2.0], [0.0, 5.0]])


def objective(x):
    return -((x - np.array([0.5, 2.0])) ** 2).sum(axis=1, keepdims=True)


def run(o, rounds, arms=3, f=objective):
    asked = []
    for _ in range(rounds):
        x = o.ask(arms)
        asked.append(x)
        o.tell(x, f(x))
    return asked


ENN = nf.ENNSurrogateConfig(k=4, fit=nf.ENNFitConfig(num_fit_samples=5, num_fit_candidates=4))
CONFIGS = {
    "zero": nf.turbo_zero_config(num_init=4),
    "lhd": nf.lhd_only_config(),
    "pareto": nf.turbo_enn_config(enn=nf.ENNSurrogateConfig(k=4), num_init=4),
    "ucb": nf.turbo_enn_config(enn=ENN, num_init=4, acq_type=nf.AcqType.UCB, candidates=nf.CandidateGenConfig(max_candidates=60, candidate_rv=nf.CandidateRV.SOBOL)),
    "thompson": nf.turbo_enn_config(enn=ENN, num_init=4, acq_type=nf.AcqType.THOMPSON, trust_region=nf.NoTRConfig(), candidates=nf.CandidateGenConfig(max_candidates=60, raasp_driver=nf.RAASPDriver.FAST)),
}


@pytest.mark.parametrize("name", list(CONFIGS))
def test_loop_and_resume(spark, tmp_path, name):
    one = nf.create_optimizer(bounds=BOX, config=CONFIGS[name], seed=5, work_dir=tmp_path / "a", spark=spark)
    first = run(one, 4)
    assert all((a >= BOX[:, 0]).all() and (a <= BOX[:, 1]).all() and a.shape == (3, 2) for a in first)
    assert one.best_y[0] == max(objective(np.concatenate(first))) and one.tr_obs_count == 12
    two = nf.create_optimizer(bounds=BOX, config=CONFIGS[name], seed=5, work_dir=tmp_path / "b", spark=spark)
    run(two, 2)
    two.close()
    again = nf.Optimizer.open(tmp_path / "b", spark)
    rest = run(again, 2)
    for a, b in zip(first[2:], rest):
        np.testing.assert_array_equal(a, b)
    assert again.tr_length == one.tr_length and again.telemetry().num_candidates == one.telemetry().num_candidates
    with pytest.raises(ValueError):
        nf.create_optimizer(bounds=BOX, config=CONFIGS[name], seed=5, work_dir=tmp_path / "a", spark=spark)
    one.close(), again.close()


def test_two_objectives(spark, tmp_path):
    region = nf.MorboTRConfig(nf.MultiObjectiveConfig(2))
    config = nf.turbo_enn_config(enn=nf.ENNSurrogateConfig(k=3), trust_region=region, num_init=4, candidates=nf.CandidateGenConfig(max_candidates=50))
    o = nf.create_optimizer(bounds=[[-300, 600], [0.2, 1]], config=config, seed=1, work_dir=tmp_path / "m", spark=spark)
    run(o, 3, f=benchmarks.separable_unimodal_objective)
    assert o.best_y is None and o.incumbent_x is not None and o.y_obs.shape == (9, 2)
    o.close()


def test_rejected_tell_changes_nothing(spark, tmp_path):
    o = nf.create_optimizer(bounds=BOX, config=CONFIGS["pareto"], seed=2, work_dir=tmp_path / "r", spark=spark)
    x = o.ask(3)
    o.tell(x, objective(x))
    state = o.files.read(f"{o.path}/state.json")
    for bad in ((x, objective(x)[:2]), (x * np.nan, objective(x)), (x + 100, objective(x)), (x, np.ones((3, 2))), (x, objective(x), np.ones((3, 1)))):
        with pytest.raises(ValueError):
            o.tell(*bad)
    assert o.files.read(f"{o.path}/state.json") == state and len(o.model) == 3
    assert o.tell(np.zeros((0, 2)), np.zeros((0, 1))).shape == (0, 1)
    with pytest.raises(ValueError):
        o.ask(0)
    o.close()


def test_restart_drops_rows_and_keeps_the_best(spark, tmp_path):
    o = nf.create_optimizer(bounds=BOX, config=CONFIGS["zero"], seed=3, work_dir=tmp_path / "s", spark=spark)
    run(o, 3)
    best = o.best_y.copy()
    o.region.length = 1e-9
    x = o.ask(2)
    assert o.tr_obs_count == 0 and o.init_progress == (0, 4) and (o.best_y == best).all()
    o.tell(x, objective(x) - 100)
    assert (o.best_y == best).all()


def test_configuration_rules():
    for bad in (
        lambda: nf.TRLengthConfig(length_init=-1), lambda: nf.TRLengthConfig(length_min=2.0), lambda: nf.TRLengthConfig(length_init=9.0),
        lambda: nf.ENNFitConfig(num_fit_candidates=3), lambda: nf.ENNFitConfig(num_fit_samples=0), lambda: nf.MultiObjectiveConfig(1), lambda: nf.MultiObjectiveConfig(2, 0.0),
        lambda: nf.CandidateGenConfig(min_candidates=-1), lambda: nf.CandidateGenConfig(candidate_rv="sobol"), lambda: nf.ENNSurrogateConfig(tied_dims=((0, 1),)),
        lambda: nf.turbo_enn_config(enn=nf.ENNSurrogateConfig(), acq_type=nf.AcqType.UCB), lambda: nf.OptimizerConfig(acquisition=cfg.UCBAcquisitionConfig()),
        lambda: nf.lhd_only_config(trust_region=nf.TurboTRConfig()), lambda: cfg.validate_tied_dims([[0], [0]]), lambda: cfg.validate_tied_dims([[5]], 3),
    ):
        with pytest.raises(ValueError):
            bad()
    c = nf.CandidateGenConfig(min_candidates=10, max_candidates=5, num_candidates_per_arm=1)
    assert c.count(3, 2) == 10 and nf.CandidateGenConfig().count(99, 4) == 5000 and nf.CandidateGenConfig().count(3, 4) == 300


def test_region_lengths():
    r = Region(3)
    r.set_arms(2)
    assert (r.length, r.patience) == (0.8, 2)
    r.update(1.0)
    for k in range(3):
        r.update(2.0 + k)
    assert r.length == 1.6
    for _ in range(2):
        r.update(4.0)
    assert r.length == 0.8 and not r.needs_restart()
    for _ in range(20):
        r.update(4.0)
    assert r.needs_restart()
    low, high = r.box(np.array([0.0, 0.5, 1.0]))
    assert (low >= 0).all() and (high <= 1).all()
    whole = WholeBox(2)
    assert whole.box(np.zeros(2))[1].tolist() == [1, 1] and not whole.needs_restart()


def test_scalarisation():
    y = np.array([[0.0, 5], [1, 5], [2, 5]])
    got = scalarized(y, y.min(axis=0), y.max(axis=0), np.array([0.6, 0.4]), 0.05)
    np.testing.assert_allclose(got, np.minimum([0, 0.3, 0.6], 0.2) + 0.05 * (np.array([0, 0.3, 0.6]) + 0.2))
    m = MorboRegion(2, nf.MorboTRConfig(nf.MultiObjectiveConfig(2)), np.random.default_rng(0))
    assert m.weights.sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        m.score(y)
    m.see(y)
    m.update_incumbent(y[1])
    other = MorboRegion(2, nf.MorboTRConfig(nf.MultiObjectiveConfig(2)), np.random.default_rng(9))
    other.load(m.state())
    assert other.state() == m.state()


def test_candidates():
    rng = np.random.default_rng(0)
    low, high, centre = np.zeros(30), np.ones(30), np.full(30, 0.5)
    for u in (gen.uniform(low, high, 50, rng), gen.perturbed(centre, low, high, 50, rng), gen.perturbed_fast(centre, low, high, 50, rng), gen.masked_sobol(centre, low, high, 50, rng)):
        assert u.shape == (50, 30) and (u >= 0).all() and (u <= 1).all()
    moved = (gen.perturbed(centre, low, high, 200, rng) != 0.5).sum(axis=1)
    assert moved.max() <= 20 and moved.min() >= 1
    h = gen.latin_hypercube(np.zeros(3), np.ones(3), 10, rng)
    assert all(sorted((10 * c).astype(int)) == list(range(10)) for c in h.T)


def test_sobol_points():
    u = gen.sobol_sequence(3, 4)
    np.testing.assert_allclose(u, [[0, 0, 0], [0.5, 0.5, 0.5], [0.75, 0.25, 0.25], [0.25, 0.75, 0.75]])
    wide = gen.sobol_sequence(60, 256)
    assert all(sorted((256 * c).astype(int)) == list(range(256)) for c in wide.T)
    assert not np.array_equal(gen.Sobol(3, np.random.default_rng(1)).take(4), u)


def test_encoder():
    kinds = [nf.DimKind.CONTINUOUS, nf.DimKind.CATEGORICAL, nf.DimKind.CATEGORICAL]
    e = nf.CatEncoder(kinds, [None, 4, 300])
    rows = np.array([[0.5, 1, 299], [0.1, 3, 0]])
    out = e.encode(rows)
    assert e.styles == ("onehot", "code") and out.shape == (2, e.num_dim) and e.num_dim == 1 + 4 + e.code_dims[1]
    assert out.tied_dims == e.tied_dims() and out[:1].tied_dims == e.tied_dims() and out[:, :2].tied_dims == ()
    assert e.snap(out + 0.1, [range(4), range(300)]).tolist() == [[1, 299], [3, 0]]
    assert [log_code_width(c) for c in (1, 2, 1000)] == [1, 9, 27] and log_code_width(10**12, 40) == 40
    assert column_plan(15)[1] == "onehot" and column_plan(16)[1] == "code"
    big = np.array([2**60, 2**60 + 1])
    assert (sign_code(big[:1], 0, 48, 0, 1.0) != sign_code(big[1:], 0, 48, 0, 1.0)).any()
    mixed = np.array([["x", 0]], dtype=object)
    for bad in (lambda: e.encode(mixed), lambda: e.encode(rows + 0.5), lambda: nf.CatEncoder(kinds), lambda: nf.CatEncoder(kinds, [None, 0, 1]), lambda: nf.CatEncoder(kinds, hash_dim=4, code_dim=3), lambda: e.encode([[0, 4, 0]])):
        with pytest.raises(ValueError):
            bad()
    hashed = nf.CatEncoder(kinds, hash_dim=8)
    assert hashed.encode(rows).shape == (2, 9)
    with pytest.raises(ValueError):
        hashed.snap(hashed.encode(rows), [range(4), range(300)])
    with pytest.raises(TypeError):
        nf.CatEncoder([1])


def test_objectives():
    assert benchmarks.ackley_core(np.ones((1, 5)))[0] == pytest.approx(0, abs=1e-12)
    assert benchmarks.Ackley(0.0, 1)(np.ones((2, 3))).tolist() == pytest.approx([0, 0], abs=1e-12)
    assert benchmarks.DoubleAckley(0.0, 1)(np.ones((1, 4))).shape == (1, 2)
    with pytest.raises(ValueError):
        benchmarks.DoubleAckley(0.0, 1)(np.ones((1, 3)))


def test_stream_ingest(spark, tmp_path, sf):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from nearfield.sources.store import ObservationStore
    from nearfield.streaming.ingest import bottom_k, ingest

    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    store = ObservationStore.create(spark, str(tmp_path / "store"), 1, 1)
    store.commit()

    def rows(batch):
        at = F.row_number().over(Window.orderBy("event_id")) - 1
        return batch.select(at.alias("position"), F.array(F.col("event_id").cast("double")).alias("x"), F.array("value").alias("y"))

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    seen = []
    ingest(stream, store, f"file://{tmp_path}/check", rows, lambda df, n: seen.append(n)).awaitTermination()
    assert seen == [0, 1, 2] and store.rows().count() == events.count()
    got = store.statistics().first()
    want = events.agg(F.stddev_pop("value")).first()[0]
    assert got["y_scale"] == pytest.approx(want)
    ids = store.rows().agg(F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()
    assert tuple(ids) == (events.count(), 0, events.count() - 1)
    a = {r["event_id"] for r in bottom_k(events, "event_id", 50, 1).collect()}
    assert a == {r["event_id"] for r in bottom_k(events.repartition(7), "event_id", 50, 1).collect()} and len(a) == 50


def test_open_replays_rows_beyond_the_state(spark, tmp_path):
    o = nf.create_optimizer(bounds=BOX, config=CONFIGS["pareto"], seed=4, work_dir=tmp_path / "p", spark=spark)
    run(o, 2)
    state = o.files.read(f"{o.path}/state.json")
    x = o.ask(2)
    o.tell(x, objective(x))
    best, length = o.best_y.copy(), o.tr_length
    o.close()
    o.files.replace(f"{o.path}/state.json", state)
    again = nf.Optimizer.open(tmp_path / "p", spark)
    assert again.tr_obs_count == 8 and (again.best_y == best).all() and again.tr_length == length
    again.close()
