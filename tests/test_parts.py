"""Edges dealt to executors against the driver's arrays."""

import sys

import numpy as np
import pytest

from graphfield import catalog, parts, schur, stochastic
from graphfield.catalog import _ids
from graphfield.decompose import _in_parts, mode_df, posterior_covariance, posterior_decomposition, prior_covariance, prior_decomposition, residual, target_of
from graphfield.fit import solve
from graphfield.precision import Theta, core, posterior_matrix, prior_matrix, sigma_1, singular_value
from graphfield.prepare import Problem, prepare
from graphfield.spec import ExactCholesky, HutchSLQ, NormalizedPrior, SpectralPrior, UnnormalizedPrior, VarianceStablePrior, Weighting

T = Theta(0.25, 0.8, 0.5, 0.4)
SCHEMA = "firm_id long, worker_id long, y double"


@pytest.fixture
def dealt(monkeypatch):
    """From here on no problem is small enough for the driver's arrays, and parts are small."""

    def on():
        monkeypatch.setattr(sys.modules["graphfield.prepare"], "LOCAL_EDGES", 0)
        monkeypatch.setattr(parts, "PART_EDGES", 40)
        monkeypatch.setattr(Problem, "arrays", property(lambda self: pytest.fail("edges on the driver")))

    return on


def sided(spark, flip):
    r = np.random.default_rng(3)
    rows = [(int(a), int(b), float(v)) for a, b, v in zip(r.integers(0, 4, 400), r.integers(0, 60, 400), r.standard_normal(400), strict=True)]
    return spark.createDataFrame([(b, a, v) if flip else (a, b, v) for a, b, v in rows], SCHEMA)


def told(p, spark):
    v = {"nll": schur.likelihoods(p, [T, Theta(-0.4, 0.7, 0.6, 0.5)]), "sums": [p.sums.k, p.sums.ydot, p.sums.within_ss, p.sums.log_weights]}
    for name in ("estimation", "personyear", "edge"):
        g = target_of(p, name)
        v[name] = [g.total, g.second_moment, *(x for x in residual(p, 1.0, g).values() if isinstance(x, float))]
        for make in (prior_decomposition, posterior_decomposition):
            x = make(p, T, name)
            v[name] += [x.V_firm, x.V_worker, x.V_cross, x.V_eps]
    if p.tier == "parts":
        v["probes"] = _in_parts(p, T, target_of(p), False, 12, 42)[0][:3]
    else:
        m = prior_matrix(p.prior.kind, p.arrays, T, sigma_1(p))
        v["probes"] = stochastic.traces(m, *target_of(p).by_node(p.arrays), 12, 42, tol=1e-13)[:3]
    v["mode"] = [r["value"] for r in _ids(p, mode_df(p, T, spark), "mode").orderBy("side", "id").collect()]
    firms, workers = ([r["id"] for r in x.orderBy("idx").collect()] for x in (p.firms, p.workers))
    for make in (prior_covariance, posterior_covariance):
        c = make(p, T)
        v[make.__name__] = [*c.block(firms=firms[:3], workers=workers[:3]).values.ravel(), *c.block(row_firms=firms[:2], col_workers=workers[-2:]).values.ravel()]
    v["singular"] = [singular_value(p)]
    return v


@pytest.mark.parametrize("flip", [False, True])
@pytest.mark.parametrize("prior,weighting", [(NormalizedPrior(), Weighting()), (UnnormalizedPrior("counts"), Weighting("effective", 0.5)), (SpectralPrior(), Weighting("edge"))])
def test_parts_of_the_larger_side(spark, dealt, flip, prior, weighting):
    """Likelihood, shares, probes, mode, covariance and singular value: no edge reaches the driver, and the numbers are the same."""
    data = sided(spark, flip)
    here = told(prepare(data, prior=prior, weighting=weighting), spark)
    dealt()
    p = prepare(data, prior=prior, weighting=weighting)
    assert p.tier == "parts" and p.parts.edges.rdd.getNumPartitions() > 1
    there = told(p, spark)
    for k, v in here.items():
        assert there[k] == pytest.approx(v, rel=1e-9, abs=2e-6 if k == "mode" else 1e-9), k


def test_probes_at_places():
    whole = stochastic.rademacher(1001, 42, 5)
    for at in (np.arange(1001), np.arange(3, 900, 7), np.array([1000, 2]), np.array([], int)):
        assert (stochastic.rademacher_at(at, 42, 5) == whole[at]).all()


def tangled(spark, copies=3):
    """Two kinds of component, each with cycles and tails, and a long path: all sides are large."""
    r = np.random.default_rng(5)
    rows = [(100 * k + int(a), 100 * k + int(b), float(v)) for k in range(copies) for a, b, v in zip(r.integers(0, 40, 90), r.integers(0, 45, 90), r.standard_normal(90), strict=True)]
    rows += [(5000 + i, 5000 + i, 1.0 + i % 3) for i in range(130)] + [(5001 + i, 5000 + i, 2.0) for i in range(130)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("prior", [NormalizedPrior(), VarianceStablePrior(0.3), SpectralPrior()])
def test_whole_components(spark, dealt, monkeypatch, prior):
    """Exact and stochastic likelihoods, the mode's norm and the log-determinant by components, against dense algebra on the driver's arrays."""
    monkeypatch.setattr(sys.modules["graphfield.prepare"], "SMALL_SIDE", 4)
    data = tangled(spark)
    p = prepare(data, prior=prior)
    x, kind, s1 = p.arrays, prior.kind, sigma_1(p)
    t, solver = Theta(0.2, 0.8, 0.5, 0.4), HutchSLQ(logdet_probes=6, lanczos_iters=12, cg_tol=1e-12)
    want = [schur.nll(kind, x, t, None, s1), stochastic.stochastic_nll(kind, x, t, solver, None, 7, s1), stochastic.mode_norm(p, t, 1e-12)[1], np.linalg.slogdet(core(kind, x, 0.2, s1).dense())[1]]
    m = posterior_matrix(kind, x, t, s1)
    b = np.concatenate([x.bf, x.bw])
    assert schur.forward(m, b) == pytest.approx((np.linalg.slogdet(m.dense())[1], b @ np.linalg.solve(m.dense(), b)))
    dealt()
    p = prepare(data, prior=prior)
    assert p.tier == "blocks" and p.parts.edges.rdd.getNumPartitions() > 3
    got = [schur.likelihoods(p, [t], s1)[0], stochastic.stochastic_likelihood(p, t, solver, 7, s1), stochastic.mode_norm(p, t, 1e-12)[1], schur.logdet(p, 0.2, s1)]
    assert got == pytest.approx(want, rel=1e-7)
    assert schur.likelihoods(p, [t, Theta(0.99, 0.8, 0.5, 0.4)], s1)[1] == (schur.PENALTY if prior.kind == "variance_stable" else pytest.approx(schur.likelihoods(p, [Theta(0.99, 0.8, 0.5, 0.4)], s1)[0]))


def test_fit_by_components(spark, dealt, monkeypatch):
    """The same fit, though no edge is on the driver."""
    monkeypatch.setattr(sys.modules["graphfield.prepare"], "SMALL_SIDE", 4)
    data, solver = tangled(spark, 1), ExactCholesky(optim_iters=12, polish=False)
    here = solve(prepare(data), solver)
    dealt()
    there = solve(prepare(data), solver)
    assert there.nll == pytest.approx(here.nll, rel=1e-9) and there.evaluations == here.evaluations
    assert there.coef == pytest.approx(here.coef, rel=1e-6)


def test_pairs_are_the_dense_product(spark):
    """A sparse side's complement from pairs of edges."""
    x = prepare(tangled(spark)).arrays
    m = posterior_matrix("normalized", x, T)
    f = schur.Factor(m)
    assert f._by_pairs() is not None
    assert np.linalg.slogdet(m.dense())[1] == pytest.approx(f.logdet)
    dense = m.dense()
    s, l = (slice(x.nf, None), slice(0, x.nf)) if f.flip else (slice(0, x.nf), slice(x.nf, None))
    assert f.schur == pytest.approx(dense[s, s] - dense[s, l] @ np.linalg.solve(dense[l, l], dense[l, s]))


def test_a_component_beyond_a_task_is_an_error(spark, dealt, monkeypatch):
    monkeypatch.setattr(sys.modules["graphfield.prepare"], "SMALL_SIDE", 4)
    monkeypatch.setattr(parts, "TASK_EDGES", 50)
    dealt()
    with pytest.raises(MemoryError):
        schur.likelihoods(prepare(tangled(spark)), [T])


def test_forest_of_many_customers(spark, tmp_path, monkeypatch):
    """forest_logdet() where neither side is small enough for a dense complement."""
    monkeypatch.setattr(schur, "MOST_SMALL", 20)
    spark.createDataFrame([(i, i % 37, float(i % 11)) for i in range(200)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = round((237 - 200) * np.log(1 - 0.36) / 200, 6)
    assert catalog.QUERIES["forest_logdet"](spark, str(tmp_path)).first()["logdet"] == pytest.approx(want, abs=1e-6)
    monkeypatch.setattr(sys.modules["graphfield.prepare"], "LOCAL_EDGES", 0)
    monkeypatch.setattr(sys.modules["graphfield.prepare"], "SMALL_SIDE", 4)
    monkeypatch.setattr(parts, "PART_EDGES", 40)
    assert catalog.QUERIES["forest_logdet"](spark, str(tmp_path)).first()["logdet"] == pytest.approx(want, abs=1e-6)
