"""Kernels without a factorisation: conjugate gradients, Lanczos quadrature, and probes dealt to executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .precision import Matrix, Theta, core, leading_singular_value, posterior_matrix, scaled_posterior, sigma_1
from .prepare import Arrays, Problem
from .schur import PENALTY, assembled

Apply = Callable[[np.ndarray], np.ndarray]
#: Edge visits (edges x probes x steps) from which probes are dealt to executors, and the most that is broadcast for them.
WORTH_DEALING, SENT_BYTES = 20_000_000, 2_000_000_000


def pcg(apply: Apply, b: np.ndarray, diag: np.ndarray, tol: float = 1e-6, maxiter: int = 700) -> tuple[np.ndarray, bool, int, float]:
    """Jacobi-preconditioned conjugate gradients from zero: solution, success, iterations, relative residual."""
    x, norm = np.zeros_like(b), np.linalg.norm(b)
    if not norm:
        return x, True, 0, 0.0
    scale = 1 / np.maximum(diag, 1e-12)
    r, z = b.copy(), scale * b
    p, rz = z.copy(), float(b @ z)
    for i in range(1, maxiter + 1):
        ap = apply(p)
        pap = float(p @ ap)
        if not np.isfinite(pap) or pap <= 0:
            return x, False, i, float(np.linalg.norm(r) / norm)
        step = rz / pap
        x += step * p
        r -= step * ap
        rel = float(np.linalg.norm(r) / norm)
        if rel <= tol:
            return x, True, i, rel
        z = scale * r
        new = float(r @ z)
        p, rz = z + new / rz * p, new
    return x, False, maxiter, rel


def rademacher(n: int, seed: int, probe: int) -> np.ndarray:
    return np.random.default_rng([seed, probe]).choice([-1.0, 1.0], n)


def rademacher_at(at: np.ndarray, seed: int, probe: int) -> np.ndarray:
    """rademacher() of a longer vector, at these places alone: each entry is the top bit of 32 of the generator, which skips what comes before."""
    if not len(at):
        return np.zeros(0)
    first = int(at.min()) // 2
    bits = np.random.PCG64(np.random.SeedSequence([seed, probe]))
    bits.advance(first)
    drawn = bits.random_raw(int(at.max()) // 2 - first + 1).astype("<u8").view("<u4")
    return 2.0 * (drawn[at - 2 * first] >> 31) - 1.0


def signs(n: int, seed: int, probe: int, probes: int) -> np.ndarray:
    """A random probe; where that many probes would take in all sign vectors (up to a common sign), the probe-th of those."""
    return 1.0 - 2.0 * ((probe >> np.arange(n)) & 1) if every(n, probes) else rademacher(n, seed, probe)


def every(n: int, probes: int) -> int:
    """The number of sign vectors up to a common sign, if it is at most ``probes``; else 0."""
    return 1 << n - 1 if n <= 40 and 1 << n - 1 <= probes else 0


def lanczos_rule(apply: Apply, v: np.ndarray, steps: int, lift: float = 0.0) -> tuple[np.ndarray, np.ndarray] | None:
    """Nodes and weights of v' f(A) v by Lanczos without reorthogonalisation; None if the recurrence isn't finite."""
    n, norm = len(v), np.linalg.norm(v)
    q, before, beta = v / norm, np.zeros(n), 0.0
    alphas, betas = [], []
    for k in range(min(steps, n)):
        w = apply(q) - beta * before
        alpha = float(q @ w)
        if not np.isfinite(alpha):
            return None
        alphas.append(alpha)
        w -= alpha * q
        beta = float(np.linalg.norm(w))
        if k + 1 == min(steps, n) or beta < 1e-14:
            break
        betas.append(beta)
        before, q = q, w / beta
    ritz, vectors = np.linalg.eigh(np.diag(np.array(alphas) + lift) + np.diag(betas, 1) + np.diag(betas, -1))
    return ritz, norm**2 * vectors[0] ** 2


def lanczos_quadrature(apply: Apply, v: np.ndarray, steps: int) -> float:
    """v' log(A) v by that rule; NaN without one."""
    rule = lanczos_rule(apply, v, steps, 1e-12)
    return float("nan") if rule is None else float((rule[1] * np.log(np.maximum(rule[0], 1e-14))).sum())


def merged_quadrature(rules: list[tuple[np.ndarray, np.ndarray] | None], steps: int) -> float:
    """lanczos_quadrature() of a block-diagonal matrix from rules of its blocks: these have the moments that ``steps`` steps see, so the same steps on all nodes give the same rule."""
    if None in rules:
        return float("nan")
    nodes, weights = (np.concatenate(v) for v in zip(*rules, strict=True))
    return lanczos_quadrature(nodes.__mul__, np.sqrt(weights), steps)


def slq_logdet(apply: Apply, n: int, probes: int = 30, steps: int = 30, seed: int = 42) -> float:
    return float(np.mean([lanczos_quadrature(apply, signs(n, seed, i, probes), steps) for i in range(every(n, probes) or probes)]))


def over_probes(spark: SparkSession, probes: int, one: Callable[[int], dict[str, float]], schema: str) -> DataFrame:
    """A row for each probe, computed in executors; ``one`` carries what it needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"probe": int(i)} | one(int(i)) for i in pdf["id"]])

    return spark.range(0, probes, 1, min(probes, spark.sparkContext.defaultParallelism)).mapInPandas(run, "probe long, " + schema)


def logdet_difference(kind: str, x: Arrays, t: Theta, probes: int, steps: int, seed: int, sigma1: float | None = None, spark: SparkSession | None = None, rho_eps: float | None = None) -> float:
    """log|M| - log|Q| on the prior's own scale, with the same probes for both.

    With a session, probes go to executors once that pays; the edge arrays are broadcast
    once for a problem, if they are at most ``SENT_BYTES``.  Each probe gives the same number
    wherever it is computed.
    """
    if kind == "spectral" and sigma1 is None:
        sigma1 = leading_singular_value(x)
    if spark is None or len(x.a) * probes * steps < WORTH_DEALING or x.nbytes > SENT_BYTES:
        m, q, n = scaled_posterior(kind, x, t, sigma1), core(kind, x, t.rho, sigma1), x.nf + x.nw
        return slq_logdet(m.__matmul__, n, probes, steps, seed) - slq_logdet(q.__matmul__, n, probes, steps, seed)
    sent = x.sent(spark)

    def one(i: int) -> dict[str, float]:
        y = sent.value
        if y.mode == "effective":
            y.weigh(rho_eps)
        v, n = rademacher(y.nf + y.nw, seed, i), {}  # a graph that is worth dealing has more sign vectors than probes
        for name, a in (("m", scaled_posterior(kind, y, t, sigma1)), ("q", core(kind, y, t.rho, sigma1))):
            n[name] = lanczos_quadrature(a.__matmul__, v, steps)
        return n

    rows = sorted(over_probes(spark, probes, one, "m double, q double").collect(), key=lambda r: r["probe"])
    return float(np.mean([r["m"] for r in rows])) - float(np.mean([r["q"] for r in rows]))


def stochastic_nll(kind: str, x: Arrays, t: Theta, solver, rho_eps: float | None = None, seed: int = 42, sigma1: float | None = None, spark: SparkSession | None = None) -> float:
    m = posterior_matrix(kind, x, t, sigma1)
    b = np.concatenate([x.bf, x.bw])
    sol, ok, _, _ = pcg(m.__matmul__, b, m.diagonal, solver.cg_tol, solver.cg_maxiter)
    if not ok:
        return PENALTY
    return assembled(x, t, rho_eps, logdet_difference(kind, x, t, solver.logdet_probes, solver.lanczos_iters, seed, sigma1, spark, rho_eps), float(b @ sol))


def stochastic_likelihood(p: Problem, t: Theta, solver, seed: int = 42, sigma1: float | None = None, spark: SparkSession | None = None) -> float:
    """stochastic_nll() where the problem's tier has it computed: on the driver's arrays, or on whole components in executors, with the same probes."""
    kind, r = p.prior.kind, p.rho_eps
    if p.tier != "blocks":
        return stochastic_nll(kind, p.arrays, t, solver, r, seed, sigma1, spark)
    sigma1 = sigma_1(p) if sigma1 is None else sigma1
    firms, probes, steps = p.n_firms, solver.logdet_probes, solver.lanczos_iters

    def one(x: Arrays) -> tuple[float, list] | None:
        m, b = posterior_matrix(kind, x, t, sigma1), np.concatenate([x.bf, x.bw])
        sol, ok, _, _ = pcg(m.__matmul__, b, m.diagonal, solver.cg_tol, solver.cg_maxiter)
        if not ok:
            return None
        both, rules = (scaled_posterior(kind, x, t, sigma1), core(kind, x, t.rho, sigma1)), []
        for i in range(probes):
            v = np.concatenate([rademacher_at(x.fs, seed, i), rademacher_at(x.ws + firms, seed, i)])
            rules.append([lanczos_rule(a.__matmul__, v, steps) for a in both])
        return float(b @ sol), rules

    found = p.parts.each(one)
    if None in found:
        return PENALTY
    m, q = ([merged_quadrature([rules[i][k] for _, rules in found], steps) for i in range(probes)] for k in (0, 1))
    return assembled(p.sums, t, r, float(np.mean(m)) - float(np.mean(q)), sum(quad for quad, _ in found))


def mode_norm(p: Problem, t: Theta, tol: float) -> tuple[bool, float]:
    """Success, and the norm of the posterior mode by conjugate gradients: each component's own, beyond the driver's arrays."""
    kind, sigma1 = p.prior.kind, sigma_1(p)

    def one(x: Arrays) -> tuple[bool, float]:
        m = posterior_matrix(kind, x, t, sigma1)
        sol, ok, _, _ = pcg(m.__matmul__, t.lam * np.concatenate([x.bf, x.bw]), m.diagonal, tol)
        return bool(ok), float(sol @ sol)

    found = p.parts.each(one) if p.tier == "blocks" else [one(p.arrays)]
    return all(ok for ok, _ in found), float(np.sqrt(sum(square for _, square in found)))


def traces(m: Matrix, wf: np.ndarray, ww: np.ndarray, we: np.ndarray, probes: int, seed: int, tol: float = 1e-6, maxiter: int = 700, spark: SparkSession | None = None) -> tuple[float, float, float, int]:
    """Hutchinson estimates of sum wf (A^-1)_ff, sum ww (A^-1)_ww and 2 sum we (A^-1)_fw; failed probes are left out and counted."""
    given = (m, wf, ww, we) if spark is None or m.nbytes > SENT_BYTES else ()

    def one(i: int, *sent) -> dict[str, float]:
        m, wf, ww, we = sent or given
        x = m.x
        z = rademacher(x.nf + x.nw, seed, i)
        u, ok, _, _ = pcg(m.__matmul__, z, m.diagonal, tol, maxiter)
        zf, zw, uf, uw = z[: x.nf], z[x.nf :], u[: x.nf], u[x.nf :]
        return {"firm": float(wf @ (zf * uf)), "worker": float(ww @ (zw * uw)), "cross": float(we @ (zf[x.f] * uw[x.w] + uf[x.f] * zw[x.w])), "ok": float(ok)}

    if spark is None or m.nbytes > SENT_BYTES:
        rows = [one(i) for i in range(probes)]
    else:
        sent = spark.sparkContext.broadcast((m, wf, ww, we))
        far = lambda i: one(i, *sent.value)
        rows = [r.asDict() for r in over_probes(spark, probes, far, "firm double, worker double, cross double, ok double").collect()]
        sent.unpersist()
    good = [r for r in rows if r["ok"]]
    if not good:
        raise ArithmeticError("no probe converged")
    mean = lambda k: float(np.mean([r[k] for r in good]))
    return mean("firm"), mean("worker"), mean("cross"), len(rows) - len(good)
