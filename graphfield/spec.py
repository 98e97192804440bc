"""What a fit is asked for: priors, weighting and solvers, checked when made."""

from __future__ import annotations

from dataclasses import dataclass

RHO_LIMIT, RHO_EPS_LIMIT, AUTO = 0.99, 0.999, "auto"
TARGETS = ("estimation", "personyear", "edge")
ALIASES = {"likelihood": "estimation", "likelihood_mean": "estimation"}


def _limit(value: float | str, auto: bool = False) -> None:
    if value == AUTO and auto:
        return
    if not isinstance(value, int | float) or not 0 < value < 1:
        raise ValueError(f"rho_limit must lie in (0, 1), not {value!r}")


def _adjacency(value: str) -> None:
    if value not in ("binary", "counts"):
        raise ValueError(f"adjacency must be 'binary' or 'counts', not {value!r}")


@dataclass(frozen=True)
class NormalizedPrior:
    """B = I - rho D^-1/2 A D^-1/2."""

    adjacency: str = "binary"
    scaling: str = "degree"
    rho_limit: float = RHO_LIMIT
    kind = "normalized"

    def __post_init__(self):
        _adjacency(self.adjacency)
        _limit(self.rho_limit)
        if self.scaling != "degree":
            raise ValueError("the only scaling is 'degree'")


@dataclass(frozen=True)
class UnnormalizedPrior:
    """B = D - rho A."""

    adjacency: str = "binary"
    rho_limit: float = RHO_LIMIT
    kind = "unnormalized"

    def __post_init__(self):
        _adjacency(self.adjacency)
        _limit(self.rho_limit)


@dataclass(frozen=True)
class SpectralPrior:
    """B = I - rho A / sigma_1(A); for the stochastic solver only."""

    adjacency: str = "binary"
    rho_limit: float = RHO_LIMIT
    seed: int = 12345
    kind = "spectral"

    def __post_init__(self):
        _adjacency(self.adjacency)
        _limit(self.rho_limit)


@dataclass(frozen=True)
class VarianceStablePrior:
    """B = I + rho^2 (D - I) - rho A; binary, raw weighting only.  rho_limit may be 'auto'."""

    rho_limit: float | str = RHO_LIMIT
    strict_forest: bool = False
    adjacency = "binary"
    kind = "variance_stable"

    def __post_init__(self):
        _limit(self.rho_limit, auto=True)


Prior = NormalizedPrior | UnnormalizedPrior | SpectralPrior | VarianceStablePrior


@dataclass(frozen=True)
class Weighting:
    """observations: raw, edge or effective; effective needs rho_eps (a number in [0, 1) or 'estimate'), others forbid it."""

    observations: str = "raw"
    rho_eps: float | str | None = None
    target: str = "estimation"

    def __post_init__(self):
        if self.observations not in ("raw", "edge", "effective"):
            raise ValueError(f"observations must be raw, edge or effective, not {self.observations!r}")
        if (self.observations == "effective") != (self.rho_eps is not None):
            raise ValueError("rho_eps goes with effective weighting, and only with it")
        if self.rho_eps is not None and self.rho_eps != "estimate" and not (isinstance(self.rho_eps, int | float) and 0 <= self.rho_eps < 1):
            raise ValueError("rho_eps must lie in [0, 1) or be 'estimate'")
        object.__setattr__(self, "target", normalized_target(self.target))


def normalized_target(target: str) -> str:
    target = ALIASES.get(target, target)
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}, not {target!r}")
    return target


def _positive(obj, *names: str) -> None:
    for n in names:
        if not getattr(obj, n) > 0:
            raise ValueError(f"{n} must be positive")


@dataclass(frozen=True)
class ExactCholesky:
    """Likelihood by elimination of the larger side; Nelder-Mead, then a finite-difference polish."""

    optim_iters: int = 200
    polish: bool = True
    autodiff: str = "finitediff"
    g_reltol: float = 1e-7

    def __post_init__(self):
        _positive(self, "optim_iters", "g_reltol")
        if self.autodiff not in ("finitediff", "none"):
            raise ValueError("autodiff must be 'finitediff' or 'none'")


@dataclass(frozen=True)
class HutchSLQ:
    """Likelihood by conjugate gradients and stochastic Lanczos quadrature."""

    logdet_probes: int = 30
    lanczos_iters: int = 30
    cg_tol: float = 1e-6
    cg_maxiter: int = 700
    optim_iters: int = 1000
    g_reltol: float = 1e-7

    def __post_init__(self):
        _positive(self, "logdet_probes", "lanczos_iters", "cg_tol", "cg_maxiter", "optim_iters", "g_reltol")
