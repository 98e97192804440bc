"""Exact kernels: the larger side is eliminated, the smaller one is dense."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .precision import Matrix, Theta, core, diagonal, nodes, off_diagonal, posterior_matrix, prior_matrix, sigma_1
from .prepare import Arrays, Problem

PENALTY = 1e30
#: Nodes of the smaller side, beyond which its dense Schur complement (8 bytes an entry) isn't made.
MOST_SMALL = 20_000
#: What a pair of edges costs, in multiplications of a dense product.
PAIR_COST = 200


class NotPositive(Exception):
    """The matrix isn't positive definite."""


class Factor:
    """Log-determinant, solves and blocks of the inverse of a Matrix."""

    block = 4096  # columns of the larger side taken at a time

    def __init__(self, m: Matrix):
        x = m.x
        self.m, self.flip = m, x.nf > x.nw  # s: the smaller side
        self.s, self.l = (x.w, x.f) if self.flip else (x.f, x.w)
        self.ps, self.dl = (m.d, m.p) if self.flip else (m.p, m.d)
        self.ns, self.nl = len(self.ps), len(self.dl)
        if not (np.isfinite(self.dl).all() and (self.dl > 0).all()):
            raise NotPositive
        if self.ns > MOST_SMALL:
            raise MemoryError(f"the smaller side has {self.ns} nodes, and its Schur complement would be dense; use the stochastic solver above {MOST_SMALL}")
        order = np.argsort(self.l, kind="stable")
        self.es, self.el, self.ec, self.order = self.s[order], self.l[order], m.c[order], order
        self.cut = np.searchsorted(self.el, np.arange(0, self.nl + self.block, self.block))
        schur = self._by_pairs()
        if schur is None:
            schur = np.diag(self.ps.astype(float))
            for k, c in self.columns():
                schur -= (c / self.dl[k : k + c.shape[1]]) @ c.T
        try:
            self.chol = np.linalg.cholesky(schur)
        except np.linalg.LinAlgError:
            raise NotPositive from None
        self.schur = schur

    def _by_pairs(self) -> np.ndarray | None:
        """The complement summed over pairs of edges that meet in a node of the larger side, where those are few against its dense products."""
        degree = np.bincount(self.el, minlength=self.nl)
        if self.ns > 4000 or (degree * (degree + 1.0)).sum() * PAIR_COST >= float(self.ns) ** 2 * self.nl:
            return None
        first, flat = np.cumsum(degree) - degree, np.zeros(self.ns**2)
        for g in np.unique(degree[degree > 0]):
            one, two = np.triu_indices(g)
            at = first[degree == g]
            step = max(1, 4_000_000 // len(one))
            for k in range(0, len(at), step):
                e = at[k : k + step, None] + np.arange(g)
                es, c, left = self.es[e], self.ec[e], self.ec[e] / self.dl[self.el[e]]
                flat += np.bincount((es[:, one] * self.ns + es[:, two]).ravel(), (left[:, one] * c[:, two]).ravel(), len(flat))
        met = flat.reshape(self.ns, self.ns)
        return np.diag(self.ps.astype(float) + np.diag(met)) - met - met.T

    def columns(self):
        for i, k in enumerate(range(0, self.nl, self.block)):
            a, b = self.cut[i], self.cut[i + 1]
            c = np.zeros((self.ns, min(self.block, self.nl - k)))
            c[self.es[a:b], self.el[a:b] - k] = self.ec[a:b]
            yield k, c

    @property
    def logdet(self) -> float:
        return float(np.log(self.dl).sum() + 2 * np.log(np.diag(self.chol)).sum())

    @cached_property
    def lower(self) -> np.ndarray:
        """The inverse of the Cholesky factor, made once for all right-hand sides."""
        return np.linalg.inv(self.chol)

    def _small(self, b: np.ndarray) -> np.ndarray:
        return self.lower.T @ (self.lower @ b)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """For a vector, firms first, or for the columns of a matrix."""
        bf, bw = b[: self.m.x.nf], b[self.m.x.nf :]
        bs, bl = (bw, bf) if self.flip else (bf, bw)
        to = lambda at, v, n: np.bincount(at, v, n) if v.ndim == 1 else np.column_stack([np.bincount(at, c, n) for c in v.T])
        by = lambda d, v: d if v.ndim == 1 else d[:, None]
        xs = self._small(bs - to(self.es, by(self.ec, b) * (bl / by(self.dl, b))[self.el], self.ns))
        xl = (bl - to(self.el, by(self.ec, b) * xs[self.es], self.nl)) / by(self.dl, b)
        return np.concatenate([xl, xs] if self.flip else [xs, xl])

    def inverse_parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the inverse: the firm diagonal, the worker diagonal, and the entry at each edge."""
        inv = self._small(np.eye(self.ns))
        large, at = 1 / self.dl, np.zeros(len(self.ec))
        for i, (k, c) in enumerate(self.columns()):
            a, b = self.cut[i], self.cut[i + 1]
            n = c.shape[1]
            sc = inv @ c / self.dl[k : k + n]
            large[k : k + n] += (c * sc).sum(0) / self.dl[k : k + n]
            at[a:b] = -sc[self.es[a:b], self.el[a:b] - k]
        edge = np.empty_like(at)
        edge[self.order] = at
        return (large, np.diag(inv), edge) if self.flip else (np.diag(inv), large, edge)


def nll(kind: str, x: Arrays, t: Theta, rho_eps: float | None = None, sigma1: float | None = None) -> float:
    """The minimised negative log-likelihood, constants dropped; a penalty where a matrix isn't positive definite."""
    try:
        q, m = Factor(prior_matrix(kind, x, t, sigma1)), Factor(posterior_matrix(kind, x, t, sigma1))
    except NotPositive:
        return PENALTY
    b = np.concatenate([x.bf, x.bw])
    return assembled(x, t, rho_eps, m.logdet - q.logdet, float(b @ m.solve(b)))


def forward(m: Matrix, b: np.ndarray) -> tuple[float, float]:
    """log|A| and b' A^-1 b of a sparse matrix: nodes of one neighbour are eliminated until none is left, then each component of the rest is factored."""
    x, d, b = m.x, m.diagonal.astype(float), b.astype(float)
    u, v, n = x.f, x.nf + x.w, x.nf + x.nw
    live, degree, gone = np.arange(len(u)), np.bincount(u, minlength=n) + np.bincount(v, minlength=n), np.zeros(n, bool)
    logdet = quad = 0.0

    def out(i: np.ndarray) -> None:
        nonlocal logdet, quad
        if not (d[i] > 0).all() or not np.isfinite(d[i]).all():
            raise NotPositive
        logdet, quad = logdet + float(np.log(d[i]).sum()), quad + float((b[i] ** 2 / d[i]).sum())
        gone[i] = True

    few = 0
    while few < 50:
        a, z = u[live], v[live]
        ends = (degree[a] == 1) | (degree[z] == 1)
        if not ends.any():
            break
        few += ends.sum() * 1000 < len(live)
        e, live = live[ends], live[~ends]
        first = degree[u[e]] == 1
        leaf, stem, c = np.where(first, u[e], v[e]), np.where(first, v[e], u[e]), m.c[e]
        out(leaf)
        d -= np.bincount(stem, c**2 / d[leaf], n)
        b -= np.bincount(stem, c * b[leaf] / d[leaf], n)
        degree -= np.bincount(stem, minlength=n)
        degree[leaf] = 0
    else:  # long tails: one node after another
        near: dict[int, dict[int, int]] = {}
        for e in live.tolist():
            near.setdefault(int(u[e]), {})[int(v[e])] = e
            near.setdefault(int(v[e]), {})[int(u[e])] = e
        todo, cut = [i for i, o in near.items() if len(o) == 1], []
        for i in todo:
            if len(near[i]) != 1:
                continue
            (stem, e), near[i] = near[i].popitem(), {}
            del near[stem][i]
            cut.append(e)
            if not (d[i] > 0 and np.isfinite(d[i])):
                raise NotPositive
            logdet, quad, gone[i] = logdet + float(np.log(d[i])), quad + float(b[i] ** 2 / d[i]), True
            d[stem] -= m.c[e] ** 2 / d[i]
            b[stem] -= m.c[e] * b[i] / d[i]
            if len(near[stem]) == 1:
                todo.append(stem)
        live = np.setdiff1d(live, cut, assume_unique=True)
    left = np.zeros(n, bool)
    left[u[live]] = left[v[live]] = True
    out(np.flatnonzero(~left & ~gone))
    if not len(live):
        return logdet, quad
    label = np.arange(n)
    while True:  # the least node of each component
        low = np.minimum(label[u[live]], label[v[live]])
        new = label.copy()
        np.minimum.at(new, u[live], low)
        np.minimum.at(new, v[live], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    of = label[u[live]]
    live = live[np.argsort(of, kind="stable")]
    for e in np.split(live, np.flatnonzero(np.diff(np.sort(of))) + 1):
        fs, f = np.unique(u[e], return_inverse=True)
        ws, w = np.unique(v[e], return_inverse=True)
        part = Factor(Matrix(SimpleNamespace(f=f, w=w, nf=len(fs), nw=len(ws)), d[fs], d[ws], m.c[e]))
        r = np.concatenate([b[fs], b[ws]])
        logdet, quad = logdet + part.logdet, quad + float(r @ part.solve(r))
    return logdet, quad


def logdet(p: Problem, rho: float, sigma1: float | None = None) -> float:
    """log|B| of a problem's prior, without the sigmas."""
    sigma1 = sigma_1(p) if sigma1 is None else sigma1
    if p.tier == "parts":
        return complements(p, [(Theta(rho, 1.0, 1.0, 1.0), False)], sigma1)[0].logdet
    kind, one = p.prior.kind, lambda x: forward(core(kind, x, rho, sigma1), np.zeros(x.nf + x.nw))[0]
    return one(p.arrays) if p.tier == "arrays" else float(sum(p.parts.each(one)))


@dataclass
class Complement:
    """What is left of Q or M when the larger side is eliminated in parts: the smaller side's matrix and right-hand side, and what the larger side adds."""

    schur: np.ndarray
    rhs: np.ndarray
    logs: float
    quad: float
    positive: bool

    @cached_property
    def chol(self) -> np.ndarray:
        if not self.positive:
            raise NotPositive
        try:
            return np.linalg.cholesky(self.schur)
        except np.linalg.LinAlgError:
            raise NotPositive from None

    @property
    def logdet(self) -> float:
        return self.logs + 2 * float(np.log(np.diag(self.chol)).sum())

    @cached_property
    def inverse(self) -> np.ndarray:
        lower = np.linalg.inv(self.chol)
        return lower.T @ lower

    def energy(self) -> float:
        """b' A^-1 b, b the weighted outcomes."""
        return self.quad + float(self.rhs @ self.inverse @ self.rhs)


def matrix_of(kind: str, t: Theta, posterior: bool, sigma1: float | None):
    make = posterior_matrix if posterior else prior_matrix
    return lambda x: make(kind, x, t, sigma1)


def split(flip: bool, first, second):
    """(smaller side's, larger side's) of (firms', workers')."""
    return (second, first) if flip else (first, second)


def complements(p: Problem, asked: list[tuple[Theta, bool]], sigma1: float | None = None) -> list[Complement]:
    """For each (theta, posterior), in one pass over the parts of a problem with a small side."""
    sigma1 = sigma_1(p) if sigma1 is None else sigma1
    flip, makes = p.parts.flip, [matrix_of(p.prior.kind, t, posterior, sigma1) for t, posterior in asked]

    def one(x) -> list[tuple]:
        out = []
        for make in makes:
            m = make(x)
            (own, d), (b, bl) = split(flip, m.p, m.d), split(flip, x.bf, x.bw)
            less, r, ok = np.zeros((len(own), len(own))), np.zeros(len(own)), bool((d > 0).all() and np.isfinite(d).all())
            for k, c in x.columns(flip, m.c):
                left = c / d[k]
                less += left @ c.T
                r += left @ bl[k]
            out.append((own, b, less, r, float(np.log(d).sum()), float((bl**2 / d).sum()), ok))
        return out

    done = []
    for rows in zip(*p.parts.each(one), strict=True):
        own, b = rows[0][:2]
        less, r, logs, quad, ok = (sum(x[i] for x in rows) for i in range(2, 7))
        done.append(Complement(np.diag(own.astype(float)) - less, b - r, logs, quad, ok == len(rows)))
    return done


def likelihoods(p: Problem, at: list[Theta], sigma1: float | None = None) -> list[float]:
    """nll() of each theta, where the problem's tier has it computed."""
    kind, sigma1 = p.prior.kind, sigma_1(p) if sigma1 is None else sigma1
    if p.tier == "arrays":
        return [nll(kind, p.arrays, t, p.rho_eps, sigma1) for t in at]

    def whole(t: Theta, terms) -> float:
        try:
            return assembled(p.sums, t, p.rho_eps, *terms())
        except NotPositive:
            return PENALTY

    if p.tier == "parts":
        found = complements(p, [(t, post) for t in at for post in (False, True)], sigma1)
        return [whole(t, lambda q=q, m=m: (m.logdet - q.logdet, m.energy())) for t, q, m in zip(at, found[::2], found[1::2], strict=True)]

    def one(x) -> list[tuple[float, float] | None]:
        out = []
        for t in at:
            try:
                q, m = (forward(matrix_of(kind, t, post, sigma1)(x), np.concatenate([x.bf, x.bw])) for post in (False, True))
                out.append((m[0] - q[0], m[1]))
            except NotPositive:
                out.append(None)
        return out

    rows = list(zip(*p.parts.each(one), strict=True))
    return [PENALTY if None in r else assembled(p.sums, t, p.rho_eps, sum(v[0] for v in r), sum(v[1] for v in r)) for t, r in zip(at, rows, strict=True)]


def within_term(x: Arrays, t: Theta, rho_eps: float | None) -> float:
    if x.mode != "effective" or not x.within_df:
        return 0.0
    return x.within_df * (2 * np.log(t.sigma_eps) + np.log(1 - rho_eps)) + x.within_ss / (t.sigma_eps**2 * (1 - rho_eps))


def assembled(x: Arrays, t: Theta, rho_eps: float | None, logdets: float, quad: float) -> float:
    v = 0.5 * (2 * x.k * np.log(t.sigma_eps) - x.log_weights + logdets + t.lam * x.ydot - t.lam**2 * quad + within_term(x, t, rho_eps))
    return float(v) if np.isfinite(v) else PENALTY


# The same where no driver holds the edges: the larger side is eliminated by a join.


def sides(p: Problem) -> tuple[str, str, str, str]:
    """The smaller side and the larger one, each by its name and its column of edges."""
    return ("worker", "w", "firm", "f") if p.n_firms > p.n_workers else ("firm", "f", "worker", "w")


def schur_pairs(p: Problem, t: Theta, posterior: bool = False, sigma1: float | None = None) -> DataFrame:
    """(i, j, value), i <= j: the Schur complement of the larger side, in indices of the smaller one.

    Two edges that meet in a node of the larger side make a pair; sums are formed before
    the shuffle, so it carries at most one row for each pair and task.
    """
    small, s, large, l = sides(p)
    d = diagonal(p, t, posterior)
    c = off_diagonal(p, t, posterior, sigma1).select(F.col(s).alias("i"), F.col(l).alias("l"), "value")
    one = c.join(d.where(F.col("side") == large).select(F.col("idx").alias("l"), F.col("value").alias("d")), "l").select("l", "i", (F.col("value") / F.col("d")).alias("left"))
    two = c.select("l", F.col("i").alias("j"), F.col("value").alias("right"))
    met = one.join(two, "l").where("i <= j").groupBy("i", "j").agg((-F.sum(F.col("left") * F.col("right"))).alias("value"))
    own = d.where(F.col("side") == small).select(F.col("idx").alias("i"), F.col("idx").alias("j"), "value")
    return own.unionByName(met).groupBy("i", "j").agg(F.sum("value").alias("value"))


def distributed_nll(p: Problem, t: Theta, sigma1: float | None = None) -> float:
    """nll() from tables: only the smaller side's complement (``MOST_SMALL`` nodes at most) and its vector reach the driver."""
    small, s, large, l = sides(p)
    n = min(p.n_firms, p.n_workers)
    if n > MOST_SMALL:
        raise MemoryError(f"the smaller side has {n} nodes, and its Schur complement would be dense; use the stochastic solver above {MOST_SMALL}")
    logdets, quad = 0.0, 0.0
    b = nodes(p).select("side", "idx", F.col("projected").alias("b"))
    for posterior, sign in ((False, -1), (True, 1)):
        d = diagonal(p, t, posterior).where(F.col("side") == large)
        least, logs = d.agg(F.min("value"), F.sum(F.log("value"))).first()
        rows = schur_pairs(p, t, posterior, sigma1).toArrow()
        i, j, v = (rows.column(c).to_numpy() for c in ("i", "j", "value"))
        a = np.zeros((n, n))
        a[i, j] = a[j, i] = v
        if not least > 0:
            return PENALTY
        try:
            chol = np.linalg.cholesky(a)
        except np.linalg.LinAlgError:
            return PENALTY
        logdets += sign * (logs + 2 * float(np.log(np.diag(chol)).sum()))
        if posterior:
            bl = b.where(F.col("side") == large).select(F.col("idx").alias(l), "b").join(d.select(F.col("idx").alias(l), F.col("value").alias("d")), l)
            quad = bl.agg(F.sum(F.col("b") ** 2 / F.col("d"))).first()[0]
            left = off_diagonal(p, t, True, sigma1).join(bl, l).groupBy(F.col(s).alias("idx")).agg(F.sum(F.col("value") * F.col("b") / F.col("d")).alias("less"))
            r = np.zeros(n)
            for x in b.where(F.col("side") == small).join(left, "idx", "left").select("idx", (F.col("b") - F.coalesce("less", F.lit(0.0))).alias("r")).collect():
                r[x["idx"]] = x["r"]
            y = np.linalg.solve(chol, r)
            quad += float(y @ y)
    return assembled(Sums(p), t, p.rho_eps, logdets, quad)


class Sums:
    """What assembled() needs of a problem, summed by Spark."""

    def __init__(self, p: Problem):
        e, self.mode = p.edges, p.weighting.observations
        raw, effective = self.mode == "raw", self.mode == "effective"
        row = e.agg(F.sum(F.col("wt") * F.col("ybar") ** 2), F.sum("ssw"), F.sum("T"), F.count("*"), F.sum(F.log("wt"))).first()
        self.ydot = row[0] + (row[1] if raw else 0.0)
        self.k = float(row[2]) if raw else row[3]
        self.within_ss, self.within_df = (row[1], float(row[2] - row[3])) if effective else (0.0, 0.0)
        self.log_weights = row[4] if effective else 0.0
