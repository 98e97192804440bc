"""Edges dealt to tasks, where the driver shouldn't hold them: ranges of the larger side's nodes, or whole components."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prepare import Arrays, Problem

#: Edges for each part, and the most that one task takes (a component is never cut; a task needs about 150 bytes for each).
PART_EDGES, TASK_EDGES = 500_000, 10_000_000
COLUMNS = ("f", "w", "T", "ybar", "ssw", "a")


class Part(Arrays):
    """A part's edges in its own indices; ``fs`` and ``ws`` hold the problem's. Of a smaller side that all parts share, sums are the whole problem's."""

    def __init__(self, t: pa.Table, mode: str, rho_eps: float | None, small: tuple[str, dict[str, np.ndarray]] | None):
        f, w, *rest = (t.column(n).to_numpy() for n in COLUMNS)
        shared = small[0] if small else ""
        order = np.lexsort((w, f) if shared == "w" else (f, w))  # within the larger side, by the smaller
        n = len(small[1]["degree"]) if small else 0
        self.fs, self.f = (np.arange(n), f[order].astype(np.int64)) if shared == "f" else np.unique(f[order], return_inverse=True)
        self.ws, self.w = (np.arange(n), w[order].astype(np.int64)) if shared == "w" else np.unique(w[order], return_inverse=True)
        self.nf, self.nw, self.mode = len(self.fs), len(self.ws), mode
        self.t, self.ybar, self.ssw, self.a = (v[order].astype(float) for v in rest)
        self.df, self.dw = np.bincount(self.f, self.a, self.nf), np.bincount(self.w, self.a, self.nw)
        self.weigh(rho_eps)
        if small:
            for name, key in (("d", "degree"), ("c", "count"), ("b", "projected")):
                setattr(self, name + shared, small[1][key])
        if (self.df <= 0).any() or (self.dw <= 0).any():
            raise ValueError("a node has no prior degree")

    def columns(self, flip: bool, *values: np.ndarray, cells: int = 4_000_000) -> Iterator[tuple]:
        """(slice of the larger side, a dense matrix for each of ``values``: smaller side by that slice)."""
        s, l, n, nl = (self.w, self.f, self.nw, self.nf) if flip else (self.f, self.w, self.nf, self.nw)
        step = max(1, cells // n)
        for k in range(0, nl, step):
            to = min(nl, k + step)
            a, b = np.searchsorted(l, (k, to))
            out = []
            for v in values:
                c = np.zeros((n, to - k))
                c[s[a:b], l[a:b] - k] = v[a:b]
                out.append(c)
            yield slice(k, to), *out


class Parts:
    """Parts of a problem; ``each`` runs a function on them in executors."""

    def __init__(self, p: Problem):
        self.p, self.small = p, None
        e = p.edges
        if p.tier == "parts":
            self.flip = p.n_firms > p.n_workers
            s, l = ("w", "f") if self.flip else ("f", "w")
            sums = e.groupBy(s).agg(F.sum("a").alias("degree"), F.sum("wt").alias("count"), F.sum(F.col("wt") * F.col("ybar")).alias("projected")).orderBy(s).toPandas()
            self.small = (s, {k: sums[k].to_numpy() for k in ("degree", "count", "projected")})
            self.edges = e.select(*COLUMNS).repartitionByRange(math.ceil(p.n_edges / PART_EDGES), l)
        else:
            self.edges = self._whole(e)
        self.edges = self.edges.persist()

    def _whole(self, e: DataFrame) -> DataFrame:
        """Edges with all of a component in one partition: large components alone, small ones together."""
        from .graph import adjacency, components

        adj = adjacency(e)
        labels = components(adj).where(F.col("node") % 2 == 0).select((F.col("node") / 2).cast("long").alias("f"), "component")
        e = e.select(*COLUMNS).join(labels, "f")
        return dealt(e, self.p.n_edges, PART_EDGES, TASK_EDGES).select(*COLUMNS)

    def rows(self, fn: Callable[[Part], pa.RecordBatch], schema: str) -> DataFrame:
        mode, r, small = self.p.weighting.observations, self.p.rho_eps, self.small

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if batches := [b for b in batches if b.num_rows]:
                with np.errstate(all="ignore"):
                    yield fn(Part(pa.Table.from_batches(batches), mode, r, small))

        return self.edges.mapInArrow(run, schema)

    def each(self, fn: Callable[[Part], object]) -> list:
        """What a function gives for each part, in order of the parts."""

        def one(x: Part) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "value": pa.array([pickle.dumps(fn(x))], pa.binary())})

        return [pickle.loads(r["value"]) for r in sorted(self.rows(one, "part int, value binary").collect(), key=lambda r: r["part"])]


def dealt(e: DataFrame, rows: int, per: int, most: int | None = None) -> DataFrame:
    """Rows with all of a component in one partition (and one ``key``): large components alone, small ones in partitions of about ``per`` rows."""
    spark = e.sparkSession
    sizes = e.groupBy("component").agg(F.count("*").alias("n")).persist()
    large = sizes.where(F.col("n") > per // 4).orderBy(F.desc("n"), "component").collect()  # at most 4 * rows / per
    sizes.unpersist()
    if most and large and large[0]["n"] > most:
        raise MemoryError(f"a component has {large[0]['n']} edges, and a task takes {most}: use the distributed products instead")
    rest = math.ceil((rows - sum(r["n"] for r in large)) / per)
    n = max(1, rest + len(large))
    keys = landing(e, n)
    own = spark.createDataFrame([(r["component"], keys[rest + i]) for i, r in enumerate(large)], "component long, own long")
    shared = F.array(*[F.lit(k).cast("long") for k in keys[: max(1, rest)]])[F.pmod(F.xxhash64("component"), F.lit(max(1, rest))).cast("int")]
    return e.join(F.broadcast(own), "component", "left").withColumn("key", F.coalesce("own", shared)).drop("own").repartition(n, "key")


def landing(df: DataFrame, n: int) -> list[int]:
    """For each of n hash partitions, a number that repartition(n, ...) puts there."""
    found: dict[int, int] = {}
    at, step = 0, 16 * n + 64
    while len(found) < n:
        for r in df.sparkSession.range(at, at + step).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("to")).collect():
            found.setdefault(r["to"], r["id"])
        at += step
    return [found[i] for i in range(n)]
