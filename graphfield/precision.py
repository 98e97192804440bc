"""Precision matrices of the priors and the posterior, as columns, coordinate tables, products and driver arrays."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prepare import Arrays, Problem
from .spec import SpectralPrior


@dataclass(frozen=True)
class Theta:
    rho: float
    sigma_a: float
    sigma_z: float
    sigma_eps: float

    @property
    def lam(self) -> float:
        return 1 / self.sigma_eps**2


def leading_singular_value(x: Arrays, seed: int | None = 12345, maxiter: int = 200, tol: float = 1e-10) -> float:
    """Power iteration on A'A from a seeded Gaussian start (all ones if seed is None); 0 for no edges."""
    if not len(x.a):
        return 0.0
    v = np.ones(x.nw) if seed is None else np.random.default_rng(seed).standard_normal(x.nw)
    v /= np.linalg.norm(v)
    old = 0.0
    for _ in range(maxiter):
        u = np.bincount(x.f, x.a * v[x.w], x.nf)
        v = np.bincount(x.w, x.a * u[x.f], x.nw)
        norm = np.linalg.norm(v)
        if not norm:
            return 0.0
        v /= norm
        now = float(np.sqrt(norm))
        if abs(now - old) <= tol * max(1.0, now):
            break
        old = now
    return now


def sigma_1(p: Problem) -> float | None:
    """The leading singular value under the problem's own seed, for the spectral prior."""
    return singular_value(p, p.prior.seed) if isinstance(p.prior, SpectralPrior) else None


def singular_value(p: Problem, seed: int | None = None, maxiter: int = 200, tol: float = 1e-10) -> float:
    """leading_singular_value() where the problem's tier has it computed; beyond the driver's arrays it starts from all ones.

    Parts give A A' of the smaller side, on which the same iteration runs.
    """
    if p.tier == "arrays":
        return leading_singular_value(p.arrays, seed, maxiter, tol)
    if p.tier == "blocks":
        return distributed_singular_value(p, maxiter, tol)
    flip = p.parts.flip
    gram = sum(p.parts.each(lambda x: sum(c @ c.T for _, c in x.columns(flip, x.a))))
    degree = p.parts.small[1]["degree"]
    v, old, now = np.ones(len(gram)) / math.sqrt(len(gram)) if flip else degree / math.sqrt(p.n_workers), 0.0, 0.0
    for _ in range(maxiter):  # v: of workers if they are the smaller side, else A times the workers' vector
        new = gram @ v
        norm = math.sqrt(float(new @ new)) if flip else math.sqrt(float(v @ new))
        if not norm:
            return 0.0
        v, now = new / norm, math.sqrt(norm)
        if abs(now - old) <= tol * max(1.0, now):
            break
        old = now
    return now


def distributed_singular_value(p: Problem, maxiter: int = 200, tol: float = 1e-10) -> float:
    """The same from tables, from all ones: each step is two joins and sums, and one number reaches the driver."""
    e = p.edges.select("f", "w", "a").where("a <> 0")
    v, old, now = p.workers.select(F.col("idx").alias("w"), F.lit(1.0 / math.sqrt(max(1, p.n_workers))).alias("x")), 0.0, 0.0
    for _ in range(maxiter):
        u = e.join(v, "w").groupBy("f").agg(F.sum(F.col("a") * F.col("x")).alias("y"))
        new = e.join(u, "f").groupBy("w").agg(F.sum(F.col("a") * F.col("y")).alias("x")).checkpoint()
        norm = math.sqrt(new.agg(F.sum(F.col("x") ** 2)).first()[0] or 0.0)
        if not norm:
            return 0.0
        v, now = new.withColumn("x", F.col("x") / norm), math.sqrt(norm)
        if abs(now - old) <= tol * max(1.0, now):
            break
        old = now
    return now


class Matrix:
    """A symmetric matrix with diagonal firm and worker blocks: diagonals p, d and one number for each edge."""

    def __init__(self, x: Arrays, p: np.ndarray, d: np.ndarray, c: np.ndarray):
        self.x, self.p, self.d, self.c = x, p, d, c

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        """Matrix-free product, firms first."""
        x, a, z = self.x, v[: self.x.nf], v[self.x.nf :]
        return np.concatenate([self.p * a + np.bincount(x.f, self.c * z[x.w], x.nf), self.d * z + np.bincount(x.w, self.c * a[x.f], x.nw)])

    @property
    def nbytes(self) -> int:
        return self.x.nbytes + self.p.nbytes + self.d.nbytes + self.c.nbytes

    @property
    def diagonal(self) -> np.ndarray:
        return np.concatenate([self.p, self.d])

    def dense(self) -> np.ndarray:
        m = np.diag(self.diagonal)
        m[self.x.f, self.x.nf + self.x.w] = m[self.x.nf + self.x.w, self.x.f] = self.c
        return m


def core(kind: str, x: Arrays, rho: float, sigma1: float | None = None) -> Matrix:
    """B, without the sigmas."""
    if kind == "normalized":
        return Matrix(x, np.ones(x.nf), np.ones(x.nw), -rho * x.a / np.sqrt(x.df[x.f] * x.dw[x.w]))
    if kind == "unnormalized":
        return Matrix(x, x.df, x.dw, -rho * x.a)
    if kind == "spectral":
        s = leading_singular_value(x) if sigma1 is None else sigma1
        return Matrix(x, np.ones(x.nf), np.ones(x.nw), -rho * x.a / s if s else 0 * x.a)
    return Matrix(x, 1 + rho**2 * (x.df - 1), 1 + rho**2 * (x.dw - 1), -rho * x.a)


def prior_matrix(kind: str, x: Arrays, t: Theta, sigma1: float | None = None) -> Matrix:
    b = core(kind, x, t.rho, sigma1)
    return Matrix(x, b.p / t.sigma_a**2, b.d / t.sigma_z**2, b.c / (t.sigma_a * t.sigma_z))


def posterior_matrix(kind: str, x: Arrays, t: Theta, sigma1: float | None = None) -> Matrix:
    q = prior_matrix(kind, x, t, sigma1)
    return Matrix(x, q.p + t.lam * x.cf, q.d + t.lam * x.cw, q.c + t.lam * x.wt)


def scaled_posterior(kind: str, x: Arrays, t: Theta, sigma1: float | None = None) -> Matrix:
    """B + lambda S V'WV S: the posterior precision without the prior's scale."""
    b = core(kind, x, t.rho, sigma1)
    return Matrix(x, b.p + t.lam * t.sigma_a**2 * x.cf, b.d + t.lam * t.sigma_z**2 * x.cw, b.c + t.lam * t.sigma_a * t.sigma_z * x.wt)


# The same as Spark expressions, for graphs that no driver holds.


def nodes(p: Problem) -> DataFrame:
    """(side, idx, degree, scale, cnt, projected): prior degree, its inverse root, observation weight and weighted outcome of each node."""
    of = lambda key, side: p.edges.groupBy(F.col(key).alias("idx")).agg(F.sum("a").alias("degree"), F.sum("wt").alias("cnt"), F.sum(F.col("wt") * F.col("ybar")).alias("projected")).select(F.lit(side).alias("side"), "idx", "degree", (1 / F.sqrt("degree")).alias("scale"), "cnt", "projected")
    return of("f", "firm").unionByName(of("w", "worker"))


def _block(kind: str, rho: float) -> Column:
    d = F.col("degree")
    return {"unnormalized": d, "variance_stable": 1 + F.lit(rho) ** 2 * (d - 1)}.get(kind, F.lit(1.0))


def diagonal(p: Problem, t: Theta, posterior: bool = False) -> DataFrame:
    """(side, idx, value): the diagonal of Q, or of M."""
    sigma = F.when(F.col("side") == "firm", t.sigma_a).otherwise(t.sigma_z)
    value = _block(p.prior.kind, t.rho) / sigma**2 + (t.lam * F.col("cnt") if posterior else 0)
    return nodes(p).select("side", "idx", value.alias("value"))


def off_diagonal(p: Problem, t: Theta, posterior: bool = False, sigma1: float | None = None) -> DataFrame:
    """(f, w, value): the edge entries of Q, or of M."""
    e = p.edges
    if p.prior.kind == "normalized":
        n = nodes(p)
        of = lambda side, key: n.where(F.col("side") == side).select(F.col("idx").alias(key), F.col("scale").alias("s" + key))
        e = e.join(of("firm", "f"), "f").join(of("worker", "w"), "w").withColumn("b", F.col("a") * F.col("sf") * F.col("sw"))
    elif p.prior.kind == "spectral":
        s = sigma_1(p) if sigma1 is None else sigma1
        e = e.withColumn("b", F.col("a") / s)
    else:
        e = e.withColumn("b", F.col("a"))
    return e.select("f", "w", (-t.rho / (t.sigma_a * t.sigma_z) * F.col("b") + (t.lam * F.col("wt") if posterior else 0)).alias("value"))


def coordinates(p: Problem, t: Theta, posterior: bool = False) -> DataFrame:
    """(i, j, value), firms first: all stored entries of Q, or of M."""
    shift = F.when(F.col("side") == "worker", p.n_firms).otherwise(0) + F.col("idx")
    d = diagonal(p, t, posterior).select(shift.alias("i"), shift.alias("j"), "value")
    o = off_diagonal(p, t, posterior).select(F.col("f").alias("i"), (F.col("w") + p.n_firms).alias("j"), "value")
    return d.unionByName(o).unionByName(o.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def product(p: Problem, t: Theta, x: DataFrame, posterior: bool = False) -> DataFrame:
    """(side, idx, value) of Q x, or M x, for x in the same form: a join and a sum for each side."""
    own = diagonal(p, t, posterior).withColumnRenamed("value", "d").join(x, ["side", "idx"]).select("side", "idx", (F.col("d") * F.col("value")).alias("value"))
    off = off_diagonal(p, t, posterior).withColumnRenamed("value", "c")
    at = lambda side, key: x.where(F.col("side") == side).select(F.col("idx").alias(key), F.col("value").alias("v"))
    to_f = off.join(at("worker", "w"), "w").groupBy(F.col("f").alias("idx")).agg(F.sum(F.col("c") * F.col("v")).alias("value")).select(F.lit("firm").alias("side"), "idx", "value")
    to_w = off.join(at("firm", "f"), "f").groupBy(F.col("w").alias("idx")).agg(F.sum(F.col("c") * F.col("v")).alias("value")).select(F.lit("worker").alias("side"), "idx", "value")
    return own.unionByName(to_f).unionByName(to_w).groupBy("side", "idx").agg(F.sum("value").alias("value"))
