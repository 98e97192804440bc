"""Variance shares of firms, workers, their covariance and noise, before and after the data; and covariance blocks by id."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stochastic
from .precision import Matrix, Theta, posterior_matrix, prior_matrix, sigma_1
from .prepare import Arrays, Problem, effective_weight
from .schur import Factor, complements, matrix_of, split
from .spec import normalized_target


@dataclass(frozen=True)
class Target:
    """A target's sums over edges, and whether noise counts by row ('annual') or by match mean."""

    name: str
    mode: str
    rho_eps: float | None
    total: float
    over_t: float
    level: str
    second_moment: float

    def weights(self, x: Arrays) -> np.ndarray:
        """Of each edge."""
        return _weight(self.name, self.mode, self.rho_eps, x.t, np.ones_like(x.t))

    def by_node(self, x: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of firms, workers and edges."""
        w = self.weights(x)
        return np.bincount(x.f, w, x.nf), np.bincount(x.w, w, x.nw), w


def _weight(name: str, mode: str, rho_eps: float | None, t, one):
    if name == "personyear" or (name == "estimation" and mode == "raw"):
        return t
    return effective_weight(t, rho_eps) if name == "estimation" and mode == "effective" else one


def target_of(p: Problem, name: str | None = None) -> Target:
    """Its sums come from the edge table; no edge reaches the driver."""
    name, mode = normalized_target(name or p.weighting.target), p.weighting.observations
    level = "annual" if name == "personyear" or (name == "estimation" and mode == "raw") else "mean"
    w = _weight(name, mode, p.rho_eps, F.col("T").cast("double"), F.lit(1.0))
    total, over_t, square, within = p.edges.agg(F.sum(w), F.sum(w / F.col("T")), F.sum(w * F.col("ybar") ** 2), F.sum("ssw")).first()
    moment = p.y_std**2 * (square + (within if level == "annual" else 0.0)) / total
    return Target(name, mode, p.rho_eps, total, over_t, level, moment)


def residual(p: Problem, sigma_eps_original: float, t: Target) -> dict[str, float | str]:
    """Noise components; compound-symmetric under effective weighting, else independent."""
    s2, factor = sigma_eps_original**2, t.over_t / t.total
    eta = p.rho_eps * s2 if p.weighting.observations == "effective" else 0.0
    annual = s2 - eta
    u = annual if t.level == "annual" else annual * factor
    return {"V_eta": eta, "V_u_annual": annual, "V_u": u, "V_eps": eta + u, "mean_factor": factor, "model": "compound_symmetric" if p.weighting.observations == "effective" else "iid"}


@dataclass(frozen=True)
class Decomposition:
    V_firm: float
    V_worker: float
    V_cross: float
    V_eps: float
    target: str
    method: str
    covariance: float | None = None
    details: dict = field(default_factory=dict)

    @property
    def V_total(self) -> float:
        return self.V_firm + self.V_worker + self.V_cross + self.V_eps

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.V_firm, self.V_worker, self.V_cross, self.V_eps, self.V_total, self.target, self.method)], "V_firm double, V_worker double, V_cross double, V_eps double, V_total double, target string, method string")


def _traces(m: Matrix, t: Target, probes: int | None, seed: int, spark: SparkSession | None) -> tuple[float, float, float, str, int]:
    firm, worker, edge = t.by_node(m.x)
    if probes is None:
        f, w, e = Factor(m).inverse_parts()
        return float(firm @ f), float(worker @ w), float(2 * edge @ e), "exact", 0
    return (*(out := stochastic.traces(m, firm, worker, edge, probes, seed, spark=spark))[:3], "hutch_pcg", out[3])


def _in_parts(p: Problem, t: Theta, goal: Target, posterior: bool, probes: int | None, seed: int) -> tuple[tuple, tuple[float, float, float]]:
    """_traces() of Q or M, and the target's sums over the squared mode and over its products across edges (0 before the data).

    With C the edge entries, D the larger side and S its complement, the inverse is 1/D +
    (C/D)' S^-1 (C/D) on the larger side and -S^-1 C/D across: weighted sums over the larger
    side are small matrices, added up over parts.  A probe's system is solved in the same
    way, exactly, where the driver's kernel uses conjugate gradients.
    """
    s1 = sigma_1(p)
    whole, make, flip = complements(p, [(t, posterior)], s1)[0], matrix_of(p.prior.kind, t, posterior, s1), p.parts.flip
    inverse, n = whole.inverse, min(p.n_firms, p.n_workers)
    top, lam, starts = whole.inverse @ whole.rhs * t.lam, t.lam, (p.n_firms, 0) if flip else (0, p.n_firms)

    def one(x: Arrays) -> list:
        m = make(x)
        d, bl, ids = split(flip, m.p, m.d)[1], split(flip, x.bf, x.bw)[1], split(flip, x.fs, x.ws)[1]
        firm, worker, edge = goal.by_node(x)
        small, large = split(flip, firm, worker)
        plain, bent, across = float((large / d).sum()), np.zeros((n, n)), np.zeros((n, n))
        modes = np.zeros(2)
        drawn = np.zeros((4, n, probes or 0))
        for k, c, w in x.columns(flip, m.c, edge):
            left = c / d[k]
            bent += (left * large[k]) @ left.T
            across += w @ left.T
            if posterior:
                low = (lam * bl[k] - c.T @ top) / d[k]
                modes += (large[k] @ low**2, float(top @ (w @ low)))
            for i in range(probes or 0):
                z = stochastic.rademacher_at(ids[k] + starts[1], seed, i)
                for j, v in enumerate((left @ z, left @ (large[k] * z), (w / d[k]) @ z, w @ z)):
                    drawn[j, :, i] += v
        return [small, plain, bent, across, modes, drawn]

    small, plain, bent, across, modes, drawn = (sum(v) for v in zip(*p.parts.each(one), strict=True))
    if probes is None:
        own, other, cross, method = float(small @ np.diag(inverse)), plain + float((inverse * bent).sum()), -2 * float((inverse * across).sum()), "exact"
    else:
        z = np.column_stack([stochastic.rademacher_at(np.arange(n) + starts[0], seed, i) for i in range(probes)])
        u = inverse @ (z - drawn[0])
        own = float((small[:, None] * z * u).sum(0).mean())
        other = plain - float((drawn[1] * u).sum(0).mean())
        cross = float((z * (drawn[2] - across @ u) + u * drawn[3]).sum(0).mean())
        method = "hutch_pcg"
    f, w = split(flip, own, other)
    a, z = split(flip, float(small @ top**2), float(modes[0]))
    return (f, w, cross, method, 0), (a, z, float(modes[1])) if posterior else (0.0, 0.0, 0.0)


def prior_decomposition(p: Problem, t: Theta, target: str | None = None, probes: int | None = None, seed: int = 42, spark: SparkSession | None = None) -> Decomposition:
    """Exact by default; with ``probes`` by Hutchinson's estimator, on executors if a session is given."""
    goal = target_of(p, target)
    if p.tier == "parts":
        f, w, c, method, lost = _in_parts(p, t, goal, False, probes, seed)[0]
    else:
        f, w, c, method, lost = _traces(prior_matrix(p.prior.kind, p.arrays, t, sigma_1(p)), goal, probes, seed, spark)
    scale, noise = p.y_std**2 / goal.total, residual(p, t.sigma_eps * p.y_std, goal)
    return Decomposition(f * scale, w * scale, c * scale, noise["V_eps"], goal.name, method, None, noise | {"second_moment": goal.second_moment, "failed_probes": lost})


def posterior_mode(p: Problem, t: Theta) -> np.ndarray:
    """M^-1 lambda b on the standardised scale, firms first."""
    x = p.arrays
    return Factor(posterior_matrix(p.prior.kind, x, t, sigma_1(p))).solve(t.lam * np.concatenate([x.bf, x.bw]))


def mode_df(p: Problem, t: Theta, spark: SparkSession) -> DataFrame:
    """(side, idx, mode); join the problem's id tables for ids."""
    if p.tier == "parts":
        whole = complements(p, [(t, True)], sigma_1(p))[0]
        return mode_from(p, t, t.lam * (whole.inverse @ whole.rhs), spark)
    return by_node(p, posterior_mode(p, t), spark)


def mode_from(p: Problem, t: Theta, top: np.ndarray, spark: SparkSession) -> DataFrame:
    """(side, idx, mode) given the smaller side's: the larger side's follows in each part, and stays there."""
    make, flip, lam = matrix_of(p.prior.kind, t, True, sigma_1(p)), p.parts.flip, t.lam

    def one(x: Arrays) -> pa.RecordBatch:
        m = make(x)
        d, b, ids = split(flip, m.p, m.d)[1], split(flip, x.bf, x.bw)[1], split(flip, x.fs, x.ws)[1]
        s, l = split(flip, x.f, x.w)
        return pa.RecordBatch.from_pydict({"idx": pa.array(ids, pa.int64()), "mode": pa.array((lam * b - np.bincount(l, m.c * top[s], len(d))) / d)})

    small, large = split(flip, "firm", "worker")
    own = spark.createDataFrame([(small, i, float(v)) for i, v in enumerate(top)], "side string, idx long, mode double")
    return own.unionByName(p.parts.rows(one, "idx long, mode double").select(F.lit(large).alias("side"), "idx", "mode"))


def by_node(p: Problem, m: np.ndarray, spark: SparkSession) -> DataFrame:
    """(side, idx, mode) of a vector, firms first."""
    n = p.n_firms
    side, idx = np.where(np.arange(len(m)) < n, "firm", "worker"), np.concatenate([np.arange(n), np.arange(len(m) - n)])
    return spark.createDataFrame(pa.table({"side": pa.array(side.tolist()), "idx": pa.array(idx, pa.int64()), "mode": pa.array(m)}))


def posterior_decomposition(p: Problem, t: Theta, target: str | None = None, probes: int | None = None, seed: int = 42, spark: SparkSession | None = None) -> Decomposition:
    goal = target_of(p, target)
    scale, noise = p.y_std**2 / goal.total, residual(p, t.sigma_eps * p.y_std, goal)
    if p.tier == "parts":
        (f, w, c, method, lost), (a, z, both) = _in_parts(p, t, goal, True, probes, seed)
        cross = (2 * both + c) * scale
        return Decomposition((a + f) * scale, (z + w) * scale, cross, noise["V_eps"], goal.name, method, cross / 2, noise | {"second_moment": goal.second_moment, "failed_probes": lost})
    x = p.arrays
    m = posterior_matrix(p.prior.kind, x, t, sigma_1(p))
    b = t.lam * np.concatenate([x.bf, x.bw])
    if probes is None:
        mode = Factor(m).solve(b)
    else:
        mode, ok, _, _ = stochastic.pcg(m.__matmul__, b, m.diagonal)
        if not ok:
            raise ArithmeticError("the posterior mode didn't converge")
    a, z = mode[: x.nf], mode[x.nf :]
    f, w, c, method, lost = _traces(m, goal, probes, seed, spark)
    firm, worker, edge = goal.by_node(x)
    cross = (2 * float((edge * a[x.f] * z[x.w]).sum()) + c) * scale
    return Decomposition((float(firm @ a**2) + f) * scale, (float(worker @ z**2) + w) * scale, cross, noise["V_eps"], goal.name, method, cross / 2, noise | {"second_moment": goal.second_moment, "failed_probes": lost})


class Covariance:
    """The inverse of Q or M, held as a factor, or as the smaller side's complement where parts hold the edges; blocks of it by entity id."""

    def __init__(self, p: Problem, t: Theta, posterior: bool, units: str = "original"):
        if units not in ("original", "scaled"):
            raise ValueError("units must be 'original' or 'scaled'")
        s1 = sigma_1(p)
        self.p, self.units, self.make = p, units, matrix_of(p.prior.kind, t, posterior, s1)
        if p.tier == "parts":
            self.whole = complements(p, [(t, posterior)], s1)[0]
        else:
            self.factor = Factor(self.make(p.arrays))

    def refs(self, firms, workers) -> list[tuple[str, object, int]]:
        out = []
        for side, ids, table, shift in (("firm", firms or [], self.p.firms, 0), ("worker", workers or [], self.p.workers, self.p.n_firms)):
            asked = [i for i in ids if i is not None]
            want = F.col("id").isin(asked) | (F.col("id").isNull() if len(asked) < len(ids) else F.lit(False))
            index = {r["id"]: r["idx"] for r in table.where(want).collect()} if ids else {}
            for i in ids:
                if i not in index:
                    raise KeyError(f"{side} {i!r} isn't in the data")
                out.append((side, i, index[i] + shift))
        return out

    def entries(self, r: list[int], c: list[int]) -> np.ndarray:
        """The inverse at rows and columns, from the edges of those nodes alone."""
        p, make, flip, inverse = self.p, self.make, self.p.parts.flip, self.whole.inverse
        starts = (p.n_firms, 0) if flip else (0, p.n_firms)
        n, both = len(inverse), np.unique([*r, *c])
        want = both[(both < starts[0]) | (both >= starts[0] + n)] - starts[1]

        def one(x: Arrays) -> dict[int, tuple[float, np.ndarray]]:
            m, ids = make(x), split(flip, x.fs, x.ws)[1]
            d = split(flip, m.p, m.d)[1]
            s, l = split(flip, x.f, x.w)
            return {int(ids[i]): (float(d[i]), np.bincount(s[l == i], m.c[l == i], n)) for i in np.flatnonzero(np.isin(ids, want))}

        found = {k: v for part in (p.parts.each(one) if len(want) else []) for k, v in part.items()}
        spread = lambda i: (np.eye(n)[i - starts[0]], 0.0) if 0 <= i - starts[0] < n else (-found[i - starts[1]][1] / found[i - starts[1]][0], 1 / found[i - starts[1]][0])
        rows, cols = [spread(i) for i in r], [spread(i) for i in c]
        return np.array([[a[0] @ inverse @ b[0] + (a[1] if i == j else 0.0) for j, b in zip(c, cols, strict=True)] for i, a in zip(r, rows, strict=True)])

    def columns(self, at: list[int], batch_size: int = 16) -> np.ndarray:
        """Columns of the inverse by unit-vector solves, ``batch_size`` at a time."""
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        n = self.p.n_firms + self.p.n_workers
        out = np.empty((n, len(at)))
        for k in range(0, len(at), batch_size):
            units = np.zeros((n, len(at[k : k + batch_size])))
            units[at[k : k + batch_size], np.arange(units.shape[1])] = 1
            out[:, k : k + batch_size] = self.factor.solve(units)
        return out

    def block(self, firms=None, workers=None, row_firms=None, row_workers=None, col_firms=None, col_workers=None, batch_size: int = 16) -> Block:
        """The principal block of firms and workers, or a rectangular one; an axis that isn't given mirrors the other."""
        principal, rectangular = firms is not None or workers is not None, any(v is not None for v in (row_firms, row_workers, col_firms, col_workers))
        if principal and rectangular:
            raise ValueError("ask for a principal or for a rectangular block, not both")
        rows = self.refs(firms, workers) if principal else self.refs(row_firms, row_workers)
        cols = rows if principal else self.refs(col_firms, col_workers)
        if rectangular and not principal:
            rows, cols = (cols, cols) if row_firms is None and row_workers is None else (rows, rows) if col_firms is None and col_workers is None else (rows, cols)
        if not rows or not cols:
            raise ValueError("the block is empty")
        r, c = [x[2] for x in rows], [x[2] for x in cols]
        values = self.entries(r, c) if self.p.tier == "parts" else self.columns(c, batch_size)[r] if len(c) <= len(r) else self.columns(r, batch_size)[c].T
        return Block(values * (self.p.y_std**2 if self.units == "original" else 1), [x[:2] for x in rows], [x[:2] for x in cols], self.units)


@dataclass(frozen=True)
class Block:
    values: np.ndarray
    rows: list[tuple[str, object]]
    cols: list[tuple[str, object]]
    units: str

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, str(i), b, str(j), float(self.values[r, c])) for r, (a, i) in enumerate(self.rows) for c, (b, j) in enumerate(self.cols)], "row_side string, row_id string, col_side string, col_id string, value double")


def prior_covariance(p: Problem, t: Theta, units: str = "original") -> Covariance:
    return Covariance(p, t, False, units)


def posterior_covariance(p: Problem, t: Theta, units: str = "original") -> Covariance:
    return Covariance(p, t, True, units)
