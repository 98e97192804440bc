"""Fitting: a start, an objective over three to five free parameters, and the result."""

from __future__ import annotations

import logging
import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import schur
from .decompose import Decomposition, prior_decomposition
from .optimize import bfgs, nelder_mead
from .precision import Theta, sigma_1
from .prepare import Problem, prepare
from .schur import PENALTY
from .spec import RHO_EPS_LIMIT, ExactCholesky, HutchSLQ, SpectralPrior, VarianceStablePrior
from .stochastic import stochastic_likelihood

log = logging.getLogger("graphfield")
#: A side's standard deviation counts as vanished below this, against an outcome with that of 1.
VANISHED = 0.02
DEPRECATED = {"N_F": "n_firms", "N_M": "n_workers", "firms_count": "n_firms", "people": "workers"}
#: Deprecated names of matrices and counts, as methods of the problem give them.
DEPRECATED_TABLES = {"A_fm": "weights", "At_fm": "weights_transposed", "cnt_m": "worker_counts"}


def to_rho_eps(u: float) -> float:
    return RHO_EPS_LIMIT / (1 + math.exp(-max(-700.0, min(700.0, u))))


def from_rho_eps(r: float) -> float:
    q = min(1 - 1e-12, max(1e-12, r / RHO_EPS_LIMIT))
    return math.log(q / (1 - q))


def validate(p: Problem, solver: ExactCholesky | HutchSLQ, fix_rho: float | None) -> None:
    if isinstance(p.prior, SpectralPrior) and isinstance(solver, ExactCholesky):
        raise ValueError("the spectral prior is for the stochastic solver")
    if isinstance(p.prior, VarianceStablePrior) and p.weighting.observations != "raw":
        raise ValueError("the variance-stable prior goes with raw weighting only")
    if fix_rho is not None and not abs(fix_rho) < p.prior.rho_limit:
        raise ValueError("|fix_rho| must be below rho_limit")


@dataclass(frozen=True)
class Result:
    problem: Problem
    solver: object
    theta: Theta
    rho_eps: float | None
    nll: float
    converged: bool
    iterations: int
    evaluations: int
    fix_rho: float | None
    status: dict = field(default_factory=dict)
    prior_decomposition: Decomposition | None = None

    @property
    def sigmas(self) -> dict[str, float]:
        """In the outcome's units."""
        s = self.problem.y_std
        return {"sigma_a": self.theta.sigma_a * s, "sigma_z": self.theta.sigma_z * s, "sigma_eps": self.theta.sigma_eps * s}

    @property
    def coef(self) -> dict[str, float]:
        return {"rho": self.theta.rho} | self.sigmas | ({} if self.rho_eps is None else {"rho_eps": self.rho_eps})

    @property
    def loglikelihood(self) -> float:
        """On the standardised scale, constants dropped."""
        return -self.nll

    @property
    def nobs(self) -> int:
        return self.problem.k

    @property
    def rho_at_bound(self) -> bool:
        return isinstance(self.problem.prior, VarianceStablePrior) and self.fix_rho is None and abs(self.theta.rho) / self.problem.prior.rho_limit >= 0.98

    def to_df(self, spark: SparkSession) -> DataFrame:
        c = self.coef
        row = (c["rho"], c["sigma_a"], c["sigma_z"], c["sigma_eps"], c.get("rho_eps"), self.nll, self.nobs, self.converged, self.iterations, self.evaluations)
        return spark.createDataFrame([row], "rho double, sigma_a double, sigma_z double, sigma_eps double, rho_eps double, nll double, nobs long, converged boolean, iterations long, evaluations long")

    def __repr__(self) -> str:
        sigmas = ", ".join(f"{k}={v:.4g}" for k, v in self.sigmas.items())
        status = f", rho_status={self.status['rho_status']}" if self.status.get("rho_status") else ""
        return f"Result(rho={self.theta.rho:.4f}, {sigmas}, nll={self.nll:.4f}, converged={self.converged}{status})"

    def __str__(self) -> str:
        lines = [repr(self.problem), *(f"  {k} = {v:.6g}" for k, v in self.coef.items()), f"  nll = {self.nll:.6g}, {self.iterations} iterations, {self.evaluations} evaluations"]
        if self.status.get("rho_limit") is not None:
            lines.append("  rho limit {rho_limit:.4f}, utilization {rho_utilization:.4f}, {rho_status}".format(**self.status))
        return "\n".join(lines)

    def __getattr__(self, name: str):
        if name in DEPRECATED:
            warnings.warn(f"{name} is deprecated; use problem.{DEPRECATED[name]}", DeprecationWarning, stacklevel=2)
            return getattr(self.problem, DEPRECATED[name])
        if name in DEPRECATED_TABLES:
            warnings.warn(f"{name} is deprecated; use problem.{DEPRECATED_TABLES[name]}()", DeprecationWarning, stacklevel=2)
            return getattr(self.problem, DEPRECATED_TABLES[name])()
        raise AttributeError(name)


def solve(p: Problem, solver: ExactCholesky | HutchSLQ | None = None, fix_rho: float | None = None, decompose: int | None = None, seed: int = 42, verbose: bool = False) -> Result:
    """Minimise the negative log-likelihood: on the driver's edge arrays, or where the problem's tier has it computed."""
    solver = solver or ExactCholesky()
    validate(p, solver, fix_rho)
    limit, free_eps, exact = p.prior.rho_limit, p.weighting.rho_eps == "estimate", isinstance(solver, ExactCholesky)
    sigma1, spark = sigma_1(p), p.edges.sparkSession

    def unpack(v: np.ndarray) -> tuple[Theta, float | None]:
        v = list(v)
        rho = fix_rho if fix_rho is not None else limit * math.tanh(v.pop(0))
        sigma = [math.exp(max(-300.0, min(300.0, s))) for s in v[:3]]
        return Theta(rho, *sigma), to_rho_eps(v[3]) if free_eps else p.rho_eps

    def likelihoods(q: Problem, at: list[Theta]) -> list[float]:
        with np.errstate(all="ignore"):
            try:
                return schur.likelihoods(q, at, sigma1) if exact else [stochastic_likelihood(q, t, solver, seed, sigma1, spark) for t in at]
            except (OverflowError, ZeroDivisionError, FloatingPointError, np.linalg.LinAlgError):
                return [PENALTY] if len(at) == 1 else [f for t in at for f in likelihoods(q, [t])]

    def many(points: list[np.ndarray]) -> list[float]:
        at = [unpack(v) for v in points]
        if not free_eps:
            found = likelihoods(p, [t for t, _ in at])
        else:
            found = [likelihoods(p.reweighed(r), [t])[0] for t, r in at]
        return [f if math.isfinite(f) else PENALTY for f in found]

    def objective(v: np.ndarray) -> float:
        return many([v])[0]

    objective.many = many
    start = [] if fix_rho is not None else [math.atanh(min(0.5, 0.5 * limit) / limit)]
    start = np.array([*start, math.log(0.7), math.log(0.04), math.log(0.4), *([from_rho_eps(0.5)] if free_eps else [])])
    f0, evaluations = objective(start), 1
    while f0 >= PENALTY and fix_rho is None and abs(start[0]) > 1e-3:  # towards rho = 0, where every prior is positive definite
        start[0] /= 2
        f0, evaluations = objective(start), evaluations + 1
    if f0 >= PENALTY and fix_rho is None:
        start[0] = 0.0
        f0, evaluations = objective(start), evaluations + 1
    tol = solver.g_reltol * max(1.0, abs(f0) if f0 < PENALTY else 1.0)
    if isinstance(solver, ExactCholesky):
        tol = max(tol, 1e-3)
    best = nelder_mead(objective, start, tol, solver.optim_iters)
    evaluations += best.evaluations
    first_end = unpack(best.x)[0]
    if best.f >= PENALTY or max(first_end.sigma_a, first_end.sigma_z) < VANISHED:  # a second start, where both sides' variances vanished from the first
        even = start.copy()
        log.info("both sides' variances vanished from the first start (nll %.6g); a second one is tried", best.f)
        first = 0 if fix_rho is not None else 1
        even[first : first + 3] = np.log([0.3, 0.4, 0.8])
        other = nelder_mead(objective, even, tol, solver.optim_iters)
        evaluations += other.evaluations
        if other.f < best.f:
            best = other
    if isinstance(solver, ExactCholesky) and solver.polish and solver.autodiff == "finitediff":
        finer = bfgs(objective, best.x, tol, solver.optim_iters)
        evaluations += finer.evaluations
        if finer.f <= best.f:
            best = finer
    t, r = unpack(best.x)
    if free_eps:
        p = p.with_rho_eps(r)
    status: dict = {"fix_rho": fix_rho}
    if isinstance(p.prior, VarianceStablePrior):
        use = abs(t.rho) / limit
        name = "fixed" if fix_rho is not None else "bound_censored" if use >= 0.98 else "interior"
        status |= {"rho_limit": limit, "rho_utilization": use, "rho_status": name, "rho_at_bound": name == "bound_censored"}
        log.log(logging.WARNING if name == "bound_censored" else logging.INFO, "rho %.4f is %.1f %% of its limit %.4f (%s)", t.rho, 100 * use, limit, name)
    shares = None
    if decompose:
        shares = prior_decomposition(p, t, seed=seed) if isinstance(solver, ExactCholesky) else prior_decomposition(p, t, probes=decompose, seed=seed)
    return Result(p, solver, t, r, best.f, best.converged and best.f < PENALTY, best.iterations, evaluations, fix_rho, status, shares)


def fit(df: DataFrame, solver: ExactCholesky | HutchSLQ | None = None, fix_rho: float | None = None, decompose: int | None = 200, seed: int = 42, **how) -> Result:
    """Prepare and solve; ``how`` goes to prepare()."""
    return solve(prepare(df, **how), solver, fix_rho, decompose, seed)
