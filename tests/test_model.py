"""The core against dense algebra and known numbers."""

import dataclasses

import numpy as np
import pytest

from graphfield import catalog, graph, schur, stochastic
from graphfield.decompose import posterior_covariance, posterior_decomposition, posterior_mode, prior_covariance, prior_decomposition
from graphfield.fit import fit, solve
from graphfield.precision import Theta, coordinates, core, distributed_singular_value, leading_singular_value, posterior_matrix, prior_matrix, product
from graphfield.prepare import Problem, cap_degree, prepare, working
from graphfield.schur import Factor, distributed_nll, nll, schur_pairs
from graphfield.spec import ExactCholesky, HutchSLQ, NormalizedPrior, SpectralPrior, UnnormalizedPrior, VarianceStablePrior, Weighting
from graphfield.stochastic import pcg, slq_logdet, stochastic_nll

T = Theta(0.25, 0.8, 0.5, 0.4)
BASIC = list(zip([1, 1, 2, 2, 3, 3, 1, 2], [10, 11, 11, 12, 12, 13, 13, 10], [1.2, 0.7, 0.9, 1.5, 1.1, 0.4, 1.0, 0.8], strict=True))
REPEATS = list(zip([1, 1, 1, 2, 2, 3, 3, 1, 2, 2], [10, 10, 11, 11, 12, 12, 13, 13, 10, 10], [1.2, 1.1, 0.7, 0.9, 1.5, 1.1, 0.4, 1.0, 0.8, 0.85], strict=True))
SCHEMA = "firm_id int, worker_id int, y double"


@pytest.fixture(scope="module")
def basic(spark):
    return spark.createDataFrame(BASIC, SCHEMA)


@pytest.fixture(scope="module")
def repeats(spark):
    return spark.createDataFrame(REPEATS, SCHEMA)


def value(p, r=None):
    return nll(p.prior.kind, p.arrays, T, r)


def test_likelihood_known(basic, repeats):
    priors = (NormalizedPrior(), UnnormalizedPrior(), SpectralPrior(), VarianceStablePrior())
    for prior, want in zip(priors, (0.555912876133, 0.626772056886, 0.554885710232, 0.366869852557), strict=True):
        assert value(prepare(basic, prior=prior, standardize=False)) == pytest.approx(want, abs=1e-9)
    for prior, want in zip(priors, (7.812218817966, 9.794783747857, 7.786046255288, 8.544550858408), strict=True):
        assert value(prepare(repeats, prior=prior)) == pytest.approx(want, abs=1e-9)
    for w, wants in ((Weighting("edge"), (7.781904044775, 9.471984187258)), (Weighting("effective", 0.5), (6.059223901978, 7.848009644243))):
        for prior, want in zip(priors, wants, strict=False):
            p = prepare(repeats, prior=prior, weighting=w)
            assert value(p, p.rho_eps) == pytest.approx(want, abs=1e-9)


def test_likelihood_is_dense_gaussian(basic):
    p = prepare(basic, standardize=False)
    x = p.arrays
    v = np.zeros((8, 7))
    y = np.empty(8)
    for i, (f, w, t) in enumerate(sorted(BASIC)):
        v[i, f - 1] = v[i, 3 + w - 10] = 1
        y[i] = t
    cov = v @ np.linalg.inv(prior_matrix("normalized", x, T).dense()) @ v.T + T.sigma_eps**2 * np.eye(8)
    assert value(p) == pytest.approx(0.5 * (np.linalg.slogdet(cov)[1] + y @ np.linalg.solve(cov, y)), abs=1e-9)


def test_factor_and_products(spark, repeats):
    for prior in (NormalizedPrior("counts"), UnnormalizedPrior(), VarianceStablePrior()):
        p = prepare(repeats, prior=prior)
        for m in (prior_matrix(prior.kind, p.arrays, T), posterior_matrix(prior.kind, p.arrays, T)):
            dense, f = m.dense(), Factor(m)
            v = np.arange(7.0) - 2
            assert m @ v == pytest.approx(dense @ v, rel=1e-10)
            assert f.logdet == pytest.approx(np.linalg.slogdet(dense)[1])
            assert f.solve(v) == pytest.approx(np.linalg.solve(dense, v))
            inv = np.linalg.inv(dense)
            a, b, e = f.inverse_parts()
            assert np.concatenate([a, b]) == pytest.approx(np.diag(inv))
            assert e == pytest.approx(inv[p.arrays.f, 3 + p.arrays.w])
        for posterior in (False, True):
            dense = (posterior_matrix if posterior else prior_matrix)(prior.kind, p.arrays, T).dense()
            got = np.zeros((7, 7))
            for r in coordinates(p, T, posterior).collect():
                got[r["i"], r["j"]] += r["value"]
            assert got == pytest.approx(dense)
            x = spark.createDataFrame([("firm" if i < 3 else "worker", i if i < 3 else i - 3, float(i) - 2) for i in range(7)], "side string, idx long, value double")
            out = np.zeros(7)
            for r in product(p, T, x, posterior).collect():
                out[r["idx"] + 3 * (r["side"] == "worker")] = r["value"]
            assert out == pytest.approx(dense @ (np.arange(7.0) - 2))


def test_singular_value(basic):
    assert leading_singular_value(prepare(basic).arrays) == pytest.approx(2.3582944711822)


def test_decompositions_mode_and_blocks(basic):
    p = prepare(basic)
    d = prior_decomposition(p, T)
    assert (d.V_firm, d.V_worker, d.V_cross) == pytest.approx((0.0736568229083, 0.0285429131339, 0.0100970330186))
    q = posterior_decomposition(p, T)
    assert (q.V_firm, q.V_worker, q.V_cross, q.V_eps, q.V_total) == pytest.approx((0.0346420674462, 0.0514598535199, -0.0309051555142, 0.0178285714286, 0.0730253368804))
    assert q.covariance == pytest.approx(q.V_cross / 2)
    assert p.y_std * posterior_mode(p, T) == pytest.approx([0.12106135, 0.07419308, -0.25830253, -0.03306182, -0.18457697, 0.33114517, -0.14042865], abs=1e-7)
    h = prior_decomposition(p, T, probes=3000)
    assert h.V_firm == pytest.approx(d.V_firm, rel=0.05) and h.method == "hutch_pcg"
    c = prior_covariance(p, T)
    assert c.block(firms=[1, 2], workers=[10]).values == pytest.approx(np.array([[0.07366215, 0.00159718, 0.0048007], [0.00159718, 0.07366215, 0.0048007], [0.0048007, 0.0048007, 0.0284696]]), abs=1e-7)
    inv = np.linalg.inv(posterior_matrix("normalized", p.arrays, T).dense())
    r = posterior_covariance(p, T, "scaled").block(row_firms=[3, 1], col_workers=[13])
    assert r.values == pytest.approx(inv[[2, 0]][:, [6]])
    with pytest.raises(KeyError):
        c.block(firms=[9])
    with pytest.raises(ValueError):
        c.block(firms=[1], row_firms=[1])
    with pytest.raises(ValueError):
        c.block(firms=[])


def test_pcg_and_slq(basic):
    a, b = np.array([[4, 1, 0], [1, 3, 0.5], [0, 0.5, 2]]), np.array([1.0, 2, 3])
    x, ok, _, _ = pcg(a.__matmul__, b, np.diag(a), 1e-12)
    assert ok and x == pytest.approx(np.linalg.solve(a, b), abs=1e-8)
    assert not pcg((-a).__matmul__, b, np.diag(a))[1]
    assert slq_logdet(a.__matmul__, 3, 200, 10) == pytest.approx(np.linalg.slogdet(a)[1], abs=0.5)
    p = prepare(basic, prior=VarianceStablePrior(0.3))
    got = stochastic_nll("variance_stable", p.arrays, T, HutchSLQ(logdet_probes=4096, cg_tol=1e-10))
    assert got == pytest.approx(value(p), abs=0.03)
    p = prepare(basic, prior=VarianceStablePrior(), standardize=False)
    for sigma_z in (0.4, 1e-6):
        t = Theta(0.25, 0.8, sigma_z, 0.4)
        got = stochastic_nll("variance_stable", p.arrays, t, HutchSLQ(logdet_probes=4096, lanczos_iters=20, cg_tol=1e-12, cg_maxiter=1000), None, 17)
        assert got == pytest.approx(nll("variance_stable", p.arrays, t), abs=0.03)


def simulated(spark, seed, firms=150, workers=150, edges=3500, reps=4, truth=(0.35, 0.8, 0.6, 0.25)):
    """Observations of effects drawn from the normalized prior on a random graph."""
    r = np.random.default_rng(seed)
    pairs = np.unique(np.column_stack([r.integers(0, firms, edges), r.integers(0, workers, edges)]), axis=0)
    rows = np.repeat(pairs, reps, 0)
    flat = spark.createDataFrame([(int(f), int(w), float(k)) for k, (f, w) in enumerate(rows)], SCHEMA)
    x = prepare(flat, standardize=False).arrays
    t = Theta(*truth)
    cov = np.linalg.inv(prior_matrix("normalized", x, t).dense())
    effects = np.linalg.cholesky(cov) @ r.standard_normal(len(cov))
    ids = {"f": np.unique(pairs[:, 0]), "w": np.unique(pairs[:, 1])}
    f, w = np.searchsorted(ids["f"], rows[:, 0]), np.searchsorted(ids["w"], rows[:, 1])
    y = effects[f] + effects[x.nf + w] + t.sigma_eps * r.standard_normal(len(rows))
    return spark.createDataFrame([(int(a), int(b), float(v)) for (a, b), v in zip(rows, y, strict=True)], SCHEMA)


def test_recovery_of_truth(spark):
    truth = Theta(0.35, 0.8, 0.6, 0.25)
    r = solve(prepare(simulated(spark, 203, 200, 200, 500), standardize=False), ExactCholesky(optim_iters=120, polish=False))
    assert r.converged and abs(r.theta.rho - truth.rho) < 0.10
    assert abs(np.log(r.theta.sigma_a / truth.sigma_a)) < 0.15 and abs(np.log(r.theta.sigma_z / truth.sigma_z)) < 0.15 and abs(np.log(r.theta.sigma_eps / truth.sigma_eps)) < 0.10


def test_solvers_agree(spark, repeats):
    p = prepare(repeats, weighting=Weighting("edge"))
    exact = solve(p, ExactCholesky(optim_iters=80), fix_rho=0.25, seed=11)
    hutch = solve(p, HutchSLQ(logdet_probes=300, lanczos_iters=8, cg_tol=1e-9, cg_maxiter=200, optim_iters=160), fix_rho=0.25, seed=11)
    assert exact.theta.rho == hutch.theta.rho == 0.25 and abs(exact.nll - hutch.nll) < 0.02
    assert abs(exact.sigmas["sigma_z"] - hutch.sigmas["sigma_z"]) < 0.02 and abs(exact.sigmas["sigma_eps"] - hutch.sigmas["sigma_eps"]) < 0.02
    assert exact.theta.sigma_a < 1e-3 and hutch.theta.sigma_a < 1e-3
    q = prepare(simulated(spark, 52, 200, 200, 500), standardize=False)
    exact = solve(q, ExactCholesky(optim_iters=160), seed=52)
    hutch = solve(q, HutchSLQ(logdet_probes=150, lanczos_iters=16, cg_tol=1e-9, cg_maxiter=300, optim_iters=160), seed=52)
    assert exact.converged and min(exact.theta.sigma_a, hutch.theta.sigma_a) > 1e-3
    assert abs(exact.theta.rho - hutch.theta.rho) < 0.20 and abs(exact.nll - hutch.nll) < 0.50
    assert max(abs(a - b) for a, b in zip(exact.sigmas.values(), hutch.sigmas.values(), strict=True)) < 0.03


def test_likelihood_from_tables(spark, basic, repeats):
    """The Schur complement by a join and the likelihood on it, against the driver's arrays."""
    for data, prior, weighting in ((basic, NormalizedPrior(), Weighting()), (repeats, UnnormalizedPrior(), Weighting("edge")), (repeats, NormalizedPrior("counts"), Weighting("effective", 0.5)), (repeats, SpectralPrior(), Weighting())):
        p = prepare(data, prior=prior, weighting=weighting)
        s1 = leading_singular_value(p.arrays, prior.seed) if prior.kind == "spectral" else None
        assert distributed_nll(p, T, s1) == pytest.approx(nll(prior.kind, p.arrays, T, p.rho_eps, s1), abs=1e-9)
    p = prepare(basic, prior=NormalizedPrior())
    m = schur_pairs(p, T, True).toPandas()
    dense = posterior_matrix("normalized", p.arrays, T).dense()
    want = dense[:3, :3] - dense[:3, 3:] @ np.linalg.solve(dense[3:, 3:], dense[3:, :3])
    assert m["value"].to_numpy() == pytest.approx(want[m["i"], m["j"]]) and len(m) == 6
    assert distributed_singular_value(p) == pytest.approx(leading_singular_value(p.arrays))
    assert distributed_nll(prepare(basic, prior=VarianceStablePrior()), Theta(0.9, 0.8, 0.5, 0.4)) == nll("variance_stable", prepare(basic, prior=VarianceStablePrior()).arrays, Theta(0.9, 0.8, 0.5, 0.4))


def test_probes_on_executors_are_the_same(spark, repeats, monkeypatch):
    for w in (Weighting(), Weighting("effective", 0.5)):
        p = prepare(repeats, weighting=w)
        here = stochastic_nll("normalized", p.arrays, T, HutchSLQ(logdet_probes=20), p.rho_eps)
        monkeypatch.setattr(stochastic, "WORTH_DEALING", 0)
        assert stochastic_nll("normalized", p.arrays, T, HutchSLQ(logdet_probes=20), p.rho_eps, spark=spark) == pytest.approx(here, abs=1e-12)
        monkeypatch.undo()


def test_too_large_for_the_dense_complement(basic, monkeypatch):
    p = prepare(basic)
    monkeypatch.setattr(schur, "MOST_SMALL", 2)
    for call in (lambda: nll("normalized", p.arrays, T), lambda: distributed_nll(p, T)):
        with pytest.raises(MemoryError):
            call()


def test_infeasible_starts_move_and_are_reported(spark):
    """A dense graph: rho starts above the ceiling, and moves towards 0 until the prior is positive definite."""
    full = spark.createDataFrame([(f, w, float((f * 7 + w * 3) % 11)) for f in range(12) for w in range(12)], SCHEMA)
    p = prepare(full, prior=VarianceStablePrior(0.99))
    r = solve(p, ExactCholesky(optim_iters=60, polish=False))
    assert r.nll < 1e6 and abs(r.theta.rho) < 1 / 11
    bad = solve(p, ExactCholesky(optim_iters=20, polish=False), fix_rho=0.9)
    assert bad.nll == schur.PENALTY and not bad.converged


def test_fit(repeats):
    r = fit(repeats, fix_rho=0.25, weighting=Weighting("edge"))
    assert r.nll == pytest.approx(4.13737073871, abs=2e-3)
    assert r.sigmas["sigma_z"] == pytest.approx(0.0975261, abs=3e-3) and r.sigmas["sigma_eps"] == pytest.approx(0.290109, abs=3e-3)
    assert r.nobs == 8 and "rho" in str(r) and r.prior_decomposition.method == "exact"
    s = solve(prepare(repeats, weighting=Weighting("effective", "estimate")))
    assert 0 <= s.rho_eps < 1 and s.problem.rho_eps == s.rho_eps


def test_prepare_rules(spark, repeats):
    d = spark.createDataFrame([("a", "p1", 1.0), ("a", "p2", None), ("b", "p2", 0.8), ("b", "p3", 1.1), ("c", "p3", 0.9), ("c", "p4", 1.2), ("c", None, float("inf"))], "employer string, person string, outcome double")
    names = {"y": "outcome", "firm": "employer", "worker": "person"}
    p = prepare(d, **names)
    assert p.n_rows == 5 and [r["id"] for r in p.firms.orderBy("idx").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        prepare(d, on_missing="error", **names)
    for bad in (lambda: prepare(d), lambda: prepare(repeats.limit(0)), lambda: prepare(repeats, max_degree=0), lambda: prepare(repeats, max_degree=1), lambda: prepare(spark.createDataFrame([(1, 1, 2.0), (2, 1, 2.0)], SCHEMA)), lambda: prepare(spark.createDataFrame([(1, 1, 2.0)], SCHEMA)), lambda: NormalizedPrior(rho_limit=1.0), lambda: Weighting("raw", 0.5), lambda: Weighting("effective"), lambda: solve(prepare(repeats), fix_rho=0.99), lambda: solve(prepare(repeats, prior=SpectralPrior()), ExactCholesky()), lambda: prepare(repeats, prior=VarianceStablePrior(strict_forest=True)), lambda: Problem.of(edges=None)):
        with pytest.raises(ValueError):
            bad()
    assert cap_degree(working(repeats), 3).count() == 2 and cap_degree(working(repeats), 4).count() == 10
    m = prepare(repeats).metadata().first()
    assert (m["unique_edges"], m["duplicate_rows"], m["max_edge_count"]) == (8, 2, 2)
    nulls = prepare(spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (1, None, 3.0)], SCHEMA))
    assert (nulls.n_firms, nulls.n_workers, nulls.n_edges) == (2, 3, 3)


def test_registered_fits_do_the_whole_job(spark, monkeypatch):
    """Default solvers, at least one fit with rho free, and default probes."""
    seen = {}

    class Stop(Exception):
        pass

    def note(name):
        def run(*args, **more):
            seen[name] = (args, more)
            raise Stop

        return run

    monkeypatch.setattr(catalog, "problem", lambda *args, **more: None)
    monkeypatch.setattr(catalog, "solve", note("solve"))
    monkeypatch.setattr(catalog.decompose, "prior_decomposition", note("prior"))
    for name, solver, free in (("fit_suppliers", ExactCholesky(), True), ("fit_stochastic", HutchSLQ(), False)):
        with pytest.raises(Stop):
            catalog.QUERIES[name](spark, "")
        args, more = seen["solve"]
        assert args[1] == solver and (more.get("fix_rho") is None) == free
    with pytest.raises(Stop):
        catalog.QUERIES["hutchinson_prior"](spark, "")
    assert seen["prior"][1]["probes"] == 200


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "f long, w long")


def test_graphs(spark):
    full = lambda n, at=0: [(at + i, at + j) for i in range(n) for j in range(n)]
    s = graph.nb_spectrum(edge_table(spark, [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3)]))
    assert s.radius == 0 and s.circuit_rank == 0 and {r["distance"] for r in s.distance.collect()} == {-1}
    assert graph.nb_spectrum(edge_table(spark, full(2))).radius == pytest.approx(1)
    s = graph.nb_spectrum(edge_table(spark, full(3) + full(2, 5)))
    assert s.radius == pytest.approx(2) and s.binding == 1 and len(s.components) == 2 and s.circuit_rank == 5
    s = graph.nb_spectrum(edge_table(spark, [*full(2), (2, 0)]))
    assert sorted(r["distance"] for r in s.distance.collect()) == [0, 0, 0, 0, 1]
    odd = edge_table(spark, [*full(3), (3, 0), (3, 1)])
    s = graph.nb_spectrum(odd)
    assert s.radius == pytest.approx(2.192574381919) and np.ptp(s.components[0].scores) > 0.01
    big = graph.nb_spectrum(odd, dense_threshold=0)
    assert big.radius == pytest.approx(s.radius, abs=1e-6) and big.components[0].scores == pytest.approx(s.components[0].scores, abs=1e-4)
    with pytest.raises(ValueError):
        graph.nb_spectrum(odd, nev=0)


def test_whole_graph_queries(spark, tmp_path):
    """Every order counts, whatever its id: cycles, a tail longer than SQL's rounds, and a tree, against brute force."""
    pairs = [(f, w) for f in range(1, 4) for w in (1, 7, 203)] + [(3 + k, 300 + k) for k in range(5)] + [(4 + k, 300 + k) for k in range(5)] + [(50, 401), (51, 401), (50, 403)]
    spark.createDataFrame([*pairs, pairs[0]], "l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {name: catalog.QUERIES[name](spark, str(tmp_path)).collect() for name in ("components", "circuit_rank", "two_core", "distance_to_core", "nb_spectrum")}
    edges = {(2 * f, 2 * w + 1) for f, w in pairs}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(start, graph):
        steps, front = dict.fromkeys(start, 0), list(start)
        for n in front:
            for m in graph.get(n, ()):
                if m not in steps:
                    steps[m] = steps[n] + 1
                    front.append(m)
        return steps

    label = {n: min(reach([n], near)) for n in near}
    assert {r["node"]: r["component"] for r in got["components"]} == label
    rank = len(edges) - len(near) + len(set(label.values()))
    assert got["circuit_rank"][0].asDict() == {"rank": rank, "forest": False}
    core = {n: set(m) for n, m in near.items()}
    while thin := [n for n in core if len(core[n]) < 2]:
        for n in thin:
            for m in core.pop(n):
                core.get(m, set()).discard(n)
    assert {(r["u"], r["v"]) for r in got["two_core"]} == {(n, m) for n in core for m in core[n]}
    steps = reach(list(core), near)
    assert max(steps.values()) > 9 and {r["node"]: r["distance"] for r in got["distance_to_core"]} == {n: steps.get(n, -1) for n in near}
    arcs = [(n, m) for n in near for m in near[n]]
    hashimoto = np.array([[float(a[1] == b[0] and a[0] != b[1]) for b in arcs] for a in arcs])
    assert got["nb_spectrum"][0]["radius"] == pytest.approx(np.abs(np.linalg.eigvals(hashimoto)).max(), abs=1e-6) and got["nb_spectrum"][0]["circuit_rank"] == rank


def test_feasibility(spark):
    k33 = spark.createDataFrame([(i, j, float(i * j + i)) for i in range(3) for j in range(3)], SCHEMA)
    p = prepare(k33, prior=VarianceStablePrior("auto"))
    assert p.prior.rho_limit == pytest.approx(0.49) and graph.feasibility(p)["rho_ceiling"] == pytest.approx(0.5)
    assert not graph.feasibility(prepare(k33, prior=VarianceStablePrior(0.9)))["safe"]
    with pytest.raises(ValueError):
        graph.feasibility(prepare(k33))


def test_limits_of_rho(spark):
    nan = float("nan")
    assert np.isnan(graph.ceiling(nan)) and np.isnan(graph.guarded_limit(nan))
    assert (graph.ceiling(0.0), graph.guarded_limit(0.0), graph.ceiling(2.0), graph.guarded_limit(2.0)) == (1.0, 0.99, 0.5, 0.49)
    full = spark.createDataFrame([(f, w, float(3 * f + w)) for f in range(1, 4) for w in range(1, 4)], SCHEMA)
    auto = prepare(full, prior=VarianceStablePrior("auto"), standardize=False)
    told = graph.feasibility(auto)
    assert auto.prior.rho_limit == pytest.approx(0.49) and told["lambda_nb"] == pytest.approx(2.0, abs=1e-10) and told["safe"] and told["source"] == "auto"
    for limit, safe in ((0.9, False), (0.5, False), (0.4999, True)):
        p = prepare(full, prior=VarianceStablePrior(limit), standardize=False)
        if limit == 0.5:
            p = dataclasses.replace(p, spectrum=graph.Spectrum(2.0, 1, 4))
        assert graph.feasibility(p)["safe"] is safe
    p = dataclasses.replace(p, spectrum=graph.Spectrum(nan, 0, 4, converged=False))
    assert not graph.feasibility(p)["safe"] and np.isnan(graph.feasibility(p)["rho_ceiling"])
    r = solve(auto, ExactCholesky(optim_iters=2, polish=False), fix_rho=0.2)
    assert "rho_status=fixed" in repr(r) and "sigma_a" in repr(r) and not r.rho_at_bound


def test_arnoldi():
    """Pairs beyond the lead one, against the dense spectrum."""
    u, v = np.nonzero(np.kron(1 - np.eye(4), np.ones((3, 3))) + np.kron(np.eye(4), 1 - np.eye(3)) * 0)
    a = np.zeros((12, 12))
    a[u, v] = 1
    got, ok = graph.arnoldi(u, v, 12, 4)
    assert ok and np.abs(got) == pytest.approx(np.abs(graph._dense(a, 4)[0]), abs=1e-6)


def test_forest_closed_form(spark):
    path = [(i, i, 1.0 + i % 3) for i in range(12)] + [(i + 1, i, 2.0) for i in range(11)]
    x = prepare(spark.createDataFrame(path, SCHEMA), prior=VarianceStablePrior()).arrays
    f = Factor(core("variance_stable", x, 0.6))
    assert f.logdet == pytest.approx(-0.446287102628)
    assert np.concatenate(f.inverse_parts()[:2]) == pytest.approx(1.5625)
