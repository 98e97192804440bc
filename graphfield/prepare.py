"""From a table of observations to the per-edge aggregate everything else is a function of."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spec import NormalizedPrior, Prior, VarianceStablePrior, Weighting

#: Driver kernels hold about 40 bytes for each edge; beyond this many, use the distributed products of graphfield.precision.
DRIVER_EDGES = 50_000_000
#: Up to so many edges, queries and fits use the driver's arrays; above, parts dealt to executors.  A smaller side of so many nodes at most is held by each part.
LOCAL_EDGES, SMALL_SIDE = 1_000_000, 64


def is_finite():
    return F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf"))


def finite(df: DataFrame) -> DataFrame:
    """Rows whose outcome is a number: no null, NaN or infinity."""
    return df.where(is_finite())


def working(df: DataFrame, y: str = "y", firm: str = "firm_id", worker: str = "worker_id") -> DataFrame:
    for c in (y, firm, worker):
        if c not in df.columns:
            raise ValueError(f"column {c!r} is missing")
    return df.select(F.col(firm).alias("firm"), F.col(worker).alias("worker"), F.col(y).cast("double").alias("y"))


def cap_degree(work: DataFrame, most: int) -> DataFrame:
    """Rows whose firm and worker each occur in at most ``most`` rows; one pass, null ids count as a node."""
    if not most > 0:
        raise ValueError("max_degree must be positive")
    few = {side: work.groupBy(F.col(side).alias("id")).count().where(F.col("count") <= most) for side in ("firm", "worker")}
    for side, ids in few.items():
        work = work.join(ids, F.col(side).eqNullSafe(F.col("id")), "left_semi")
    return work


def collapse(work: DataFrame) -> DataFrame:
    """One row for each (firm, worker): count, mean and sum of squares within."""
    return work.groupBy("firm", "worker").agg(F.count("*").alias("T"), F.avg("y").alias("y_mean"), (F.var_pop("y") * F.count("*")).alias("ssw"))


def dense_index(ids: DataFrame, name: str) -> DataFrame:
    """(id, idx): 0, 1, ... in order of id, nulls first.  Ids are sorted in ranges, each numbered apart, so no task sees all."""
    ids = ids.select(F.col(name).alias("id")).distinct()
    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = ids.repartitionByRange(parts, F.asc_nulls_first("id")).withColumn("part", F.spark_partition_id()).persist()
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # one row for each partition
    before, at = {}, 0
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    offset = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]) if before else F.create_map()
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("id"))) - 1
    return ranged.select("id", (rank + (offset[F.col("part").cast("long")] if before else 0)).cast("long").alias("idx"))


def effective_weight(t, r):
    return t / (1 + r * (t - 1))


@dataclass(frozen=True)
class Problem:
    """Edges on the standardised scale (firm, worker, f, w, T, ybar, ssw, wt, a), the two id tables, and what is summed over them."""

    edges: DataFrame
    firms: DataFrame
    workers: DataFrame
    prior: Prior
    weighting: Weighting
    n_firms: int
    n_workers: int
    n_rows: int
    n_edges: int
    y_mean: float
    y_std: float
    rho_eps: float | None
    forest: bool | None = None
    spectrum: object = None

    @classmethod
    def of(cls, **given) -> Problem:
        """From exactly all fields."""
        names = [f.name for f in fields(cls)]
        if missing := [n for n in names if n not in given]:
            raise ValueError(f"missing fields: {missing}")
        if unknown := [n for n in given if n not in names]:
            raise ValueError(f"unknown fields: {unknown}")
        return cls(**given)

    def as_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @property
    def k(self) -> int:
        """Number of observations in the likelihood."""
        return self.n_rows if self.weighting.observations == "raw" else self.n_edges

    @property
    def tier(self) -> str:
        """Where kernels run: on the driver's 'arrays', on 'parts' of the larger side, or on 'blocks' of whole components."""
        return "arrays" if self.n_edges <= LOCAL_EDGES else "parts" if min(self.n_firms, self.n_workers) <= SMALL_SIDE else "blocks"

    @cached_property
    def parts(self):
        """The edges dealt to executors, above LOCAL_EDGES."""
        from .parts import Parts

        return Parts(self)

    @cached_property
    def sums(self):
        """What the likelihood needs besides its matrices, summed by Spark."""
        from .schur import Sums

        return Sums(self)

    @cached_property
    def arrays(self) -> Arrays:
        """The edges on the driver, for the kernels there."""
        if self.n_edges > DRIVER_EDGES:
            raise MemoryError(f"{self.n_edges} edges: use the distributed products instead")
        t = self.edges.select("f", "w", "T", "ybar", "ssw", "a").toArrow()
        col = lambda n: t.column(n).to_numpy()
        order = np.lexsort((col("w"), col("f")))
        return Arrays(self, *(col(n)[order] for n in ("f", "w", "T", "ybar", "ssw", "a")))

    def with_rho_eps(self, r: float) -> Problem:
        """The same data under another within-edge correlation of the noise."""
        return replace(self, rho_eps=r, edges=self.edges.withColumn("wt", effective_weight(F.col("T"), F.lit(r))))

    def reweighed(self, r: float) -> Problem:
        """with_rho_eps(), sharing the driver's arrays where those are used."""
        q = self.with_rho_eps(r)
        if self.tier == "arrays":
            vars(q)["arrays"] = self.arrays.weigh(r)
        return q

    def weights(self) -> DataFrame:
        """(f, w, value): the prior's edge weights, firms in rows."""
        return self.edges.select("f", "w", F.col("a").alias("value"))

    def weights_transposed(self) -> DataFrame:
        """(w, f, value): the same, workers in rows."""
        return self.edges.select("w", "f", F.col("a").alias("value"))

    def worker_counts(self) -> DataFrame:
        """(w, value): observation weight of each worker."""
        return self.edges.groupBy("w").agg(F.sum("wt").alias("value"))

    def released(self) -> Problem:
        """Drop what prepare() keeps in memory."""
        for d in (self.edges, self.firms, self.workers, *([self.parts.edges] if "parts" in vars(self) else [])):
            d.unpersist()
        return self

    def metadata(self) -> DataFrame:
        e = self.edges
        degree = lambda s: e.groupBy(s).agg(F.sum("a").alias("d")).agg(F.max("d").alias("m"))
        return (
            e.agg(F.count("*").alias("unique_edges"), (F.sum("T") - F.count("*")).alias("duplicate_rows"), F.avg("T").alias("mean_edge_count"), F.max("T").alias("max_edge_count"), F.sum("a").alias("total_prior_weight"),
                  F.sum("wt").alias("total_weight"), F.avg("wt").alias("mean_weight"), F.max("wt").alias("max_weight"))
            .crossJoin(degree("f").withColumnRenamed("m", "max_firm_degree"))
            .crossJoin(degree("w").withColumnRenamed("m", "max_worker_degree"))
        )  # three one-row aggregates side by side

    def __repr__(self) -> str:
        return f"Problem({self.n_firms} firms, {self.n_workers} workers, {self.n_edges} edges, {self.n_rows} rows, {self.prior.kind}, {self.weighting.observations})"


class Arrays:
    """Edge arrays and sums over nodes, under a weighting; all on the standardised scale."""

    def __init__(self, p: Problem, f, w, t, ybar, ssw, a):
        self.nf, self.nw, self.f, self.w, self.t, self.ybar, self.ssw, self.a = p.n_firms, p.n_workers, f.astype(np.int64), w.astype(np.int64), t.astype(float), ybar, ssw, a.astype(float)
        self.mode = p.weighting.observations
        self.df, self.dw = np.bincount(f, self.a, self.nf), np.bincount(w, self.a, self.nw)
        if (self.df <= 0).any() or (self.dw <= 0).any():
            raise ValueError("a node has no prior degree")
        self.weigh(p.rho_eps)

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))

    def sent(self, spark):
        """These arrays as a broadcast, made once."""
        if self.__dict__.get("_sent") is None:
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_sent"}

    def weigh(self, rho_eps: float | None) -> Arrays:
        self.wt = self.t if self.mode == "raw" else np.ones_like(self.t) if self.mode == "edge" else effective_weight(self.t, rho_eps)
        self.cf, self.cw = np.bincount(self.f, self.wt, self.nf), np.bincount(self.w, self.wt, self.nw)
        self.bf, self.bw = np.bincount(self.f, self.wt * self.ybar, self.nf), np.bincount(self.w, self.wt * self.ybar, self.nw)
        self.ydot = float((self.wt * self.ybar**2).sum() + (self.ssw.sum() if self.mode == "raw" else 0))
        self.k = float(self.t.sum()) if self.mode == "raw" else len(self.t)
        effective = self.mode == "effective"
        self.within_ss, self.within_df = (float(self.ssw.sum()), float(self.t.sum() - len(self.t))) if effective else (0.0, 0.0)
        self.log_weights = float(np.log(self.wt).sum()) if effective else 0.0
        return self


def prepare(df: DataFrame, y: str = "y", firm: str = "firm_id", worker: str = "worker_id", prior: Prior | None = None, weighting: Weighting | None = None, standardize: bool = True, on_missing: str = "drop", max_degree: int | None = None, verbose: bool = False) -> Problem:
    """Clean, standardise, collapse and index a table of observations."""
    prior, weighting = prior or NormalizedPrior(), weighting or Weighting()
    if on_missing not in ("drop", "error"):
        raise ValueError("on_missing must be 'drop' or 'error'")
    work = working(df, y, firm, worker)
    if work.isEmpty():
        raise ValueError("the dataset is empty")
    if isinstance(prior, VarianceStablePrior) and weighting.observations != "raw":
        raise ValueError("the variance-stable prior goes with raw weighting only")
    if max_degree is not None:
        work = cap_degree(work, max_degree)
        if work.isEmpty():
            raise ValueError("nothing is left after the degree filter")
    clean = finite(work)
    if on_missing == "error" and not work.where(~F.coalesce(is_finite(), F.lit(False))).limit(1).isEmpty():
        raise ValueError("the outcome has missing or non-finite values")
    edges = collapse(clean).persist()  # the table is read once; what follows comes from its edges
    n, mean = edges.agg(F.coalesce(F.sum("T"), F.lit(0)), F.sum(F.col("T") * F.col("y_mean")) / F.sum("T")).first()
    if not n:
        raise ValueError("nothing is left after missing outcomes are dropped")
    around = edges.agg(F.sum(F.col("ssw") + F.col("T") * (F.col("y_mean") - mean) ** 2)).first()[0]
    std = math.sqrt(around / (n - 1)) if n > 1 else None
    if standardize and not (std and math.isfinite(std)):
        raise ValueError("the outcome has no spread")
    mean, std = (mean, std) if standardize else (0.0, 1.0)
    firms, workers = dense_index(edges, "firm").persist(), dense_index(edges, "worker").persist()
    r = None if weighting.rho_eps is None else 0.5 if weighting.rho_eps == "estimate" else float(weighting.rho_eps)
    wt = {"raw": F.col("T").cast("double"), "edge": F.lit(1.0), "effective": effective_weight(F.col("T"), F.lit(r))}[weighting.observations]
    a = F.col("T").cast("double") if prior.adjacency == "counts" else F.lit(1.0)
    ids = lambda d, x: d.select(F.col("id").alias(x + "_id"), F.col("idx").alias(x))
    edges = (
        edges.join(ids(firms, "f"), F.col("firm").eqNullSafe(F.col("f_id")))
        .join(ids(workers, "w"), F.col("worker").eqNullSafe(F.col("w_id")))
        .select("firm", "worker", "f", "w", "T", ((F.col("y_mean") - mean) / std).alias("ybar"), (F.col("ssw") / std**2).alias("ssw"), wt.alias("wt"), a.alias("a"))
        .persist()
    )
    n_edges = edges.count()
    problem = Problem(edges, firms, workers, prior, weighting, firms.count(), workers.count(), n, n_edges, mean, std, r)
    if isinstance(prior, VarianceStablePrior):
        from .graph import resolve

        problem = resolve(problem)
    return problem

