"""Queries over the driver's tables, and the same in SQL: preparation, precision, likelihood, decomposition, graph."""

from __future__ import annotations

import dataclasses
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decompose, graph, precision, prepare, schur, stochastic
from .fit import fit, solve
from .precision import Theta
from .spec import ExactCholesky, HutchSLQ, NormalizedPrior, SpectralPrior, UnnormalizedPrior, VarianceStablePrior, Weighting

THETA = Theta(0.25, 0.8, 0.5, 0.4)
#: Bipartite views: table, firm, worker, outcome, number of firms.
VIEWS = {"ue": ("events", "event_type", "user_id", "value", 5), "oc": ("orders", "o_orderpriority", "o_custkey", "o_totalprice", 5), "sn": ("customer", "c_mktsegment", "c_nationkey", "c_acctbal", 5), "sp": ("lineitem", "l_suppkey", "l_partkey", "l_extendedprice", 0), "co": ("orders", "o_custkey", "o_orderkey", "o_totalprice", 0)}
PRIORS = {"normalized": NormalizedPrior(), "counts": NormalizedPrior("counts"), "unnormalized": UnnormalizedPrior(), "variance_stable": VarianceStablePrior()}
MODES = {"raw": Weighting(), "edge": Weighting("edge"), "effective": Weighting("effective", 0.5)}
WEIGHT_SQL = {"raw": "CAST(T AS DOUBLE)", "edge": "CAST(1 AS DOUBLE)", "effective": "T / (1 + 0.5 * (T - 1))"}

Q: dict = {}
QUERIES: dict = Q
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, d: str, view: str) -> tuple[DataFrame, dict]:
    table, firm, worker, y, _ = VIEWS[view]
    return spark.read.parquet(f"{d}/{table}.parquet"), {"y": y, "firm": firm, "worker": worker}


def problem(spark, d, view="ue", prior="normalized", mode="raw", **more):
    df, names = load(spark, d, view)
    return prepare.prepare(df, **names, prior=PRIORS[prior] if isinstance(prior, str) else prior, weighting=MODES[mode], **more)


def r6(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def one(spark, **values) -> DataFrame:
    kinds = {float: "double", int: "long", bool: "boolean", str: "string"}
    values = {k: v.item() if isinstance(v, np.generic) else v for k, v in values.items()}
    values = {k: round(v, 6) + 0.0 if isinstance(v, float) else v for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def base(view: str, mode: str = "raw", counts: bool = False) -> str:
    table, firm, worker, y, _ = VIEWS[view]
    return f"""WITH work AS (SELECT {firm} AS firm, {worker} AS worker, CAST({y} AS DOUBLE) AS y FROM {table}),
clean AS (SELECT * FROM work WHERE y IS NOT NULL AND isfinite(y)),
st AS (SELECT avg(y) AS m, stddev_samp(y) AS s, count(*) AS n FROM clean),
edges AS (SELECT firm, worker, count(*) AS T, (avg(y) - any_value(m)) / any_value(s) AS ybar, var_pop(y) * count(*) / any_value(s) ** 2 AS ssw FROM clean, st GROUP BY 1, 2),
e AS MATERIALIZED (SELECT *, {WEIGHT_SQL[mode]} AS wt, {'CAST(T AS DOUBLE)' if counts else 'CAST(1 AS DOUBLE)'} AS a FROM edges),
fn AS MATERIALIZED (SELECT firm, sum(a) AS d, sum(wt) AS c, sum(wt * ybar) AS b FROM e GROUP BY 1),
wn AS MATERIALIZED (SELECT worker, sum(a) AS d, sum(wt) AS c, sum(wt * ybar) AS b FROM e GROUP BY 1)
"""


def prior_sql(kind: str, t: Theta = THETA) -> tuple[str, str]:
    """The diagonal of B at a degree d, and B's edge entry over -rho, in SQL."""
    diag = {"unnormalized": "d", "variance_stable": f"1 + {t.rho**2!r} * (d - 1)"}.get(kind, "1.0")
    return diag, "a / sqrt(fd * wd)" if kind in ("normalized", "counts") else "a"


def matrix_sql(kind: str, t: Theta = THETA) -> str:
    """CTEs: pf, pw with the diagonals of Q and M, and c with their edge entries."""
    diag, off = prior_sql(kind, t)
    return f""", pf AS MATERIALIZED (SELECT firm, row_number() OVER (ORDER BY firm NULLS FIRST) AS i, b, d, c AS cnt, ({diag}) / {t.sigma_a**2!r} AS q, ({diag}) / {t.sigma_a**2!r} + {t.lam!r} * c AS m FROM fn),
pw AS MATERIALIZED (SELECT worker, b, d, c AS cnt, ({diag}) / {t.sigma_z**2!r} AS q, ({diag}) / {t.sigma_z**2!r} + {t.lam!r} * c AS m FROM wn),
c AS MATERIALIZED (SELECT firm, worker, i, wt, wb AS wb, ({-t.rho!r}) / {t.sigma_a * t.sigma_z!r} * ({off}) AS q, ({-t.rho!r}) / {t.sigma_a * t.sigma_z!r} * ({off}) + {t.lam!r} * wt AS m, wq, wm, wcnt
 FROM (SELECT e.*, pf.i, pf.d AS fd, pw.d AS wd, pw.b AS wb, pw.q AS wq, pw.m AS wm, pw.cnt AS wcnt FROM e JOIN pf USING (firm) JOIN pw USING (worker)))
"""


def eliminated(n: int, which: str) -> str:
    """CTEs that eliminate workers and then firms one by one; {which}0..n-1 hold the rows left before each pivot."""
    out = f""", {which}0 AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (
 SELECT i, i AS j, {which} AS v FROM pf UNION ALL SELECT x.i, y.i, -sum(x.{which} * y.{which} / x.w{which}) FROM c x JOIN c y USING (worker) GROUP BY 1, 2
 UNION ALL SELECT i, 0, b FROM pf UNION ALL SELECT i, 0, -sum({which} * wb / w{which}) FROM c GROUP BY 1) GROUP BY 1, 2)"""
    for k in range(1, n):
        p = f"{which}{k - 1}"
        out += f""",
{which}{k} AS MATERIALIZED (SELECT s.i, s.j, s.v - a.v * b.v / (SELECT v FROM {p} WHERE i = {k} AND j = {k}) AS v FROM {p} s JOIN {p} a ON a.i = s.i AND a.j = {k} JOIN {p} b ON b.i = {k} AND b.j = s.j WHERE s.i > {k} AND (s.j > {k} OR s.j = 0))"""
    return out


def nll_sql(view: str, kind: str, mode: str, t: Theta = THETA, name: str = "nll", prefix: str = "") -> str:
    n = VIEWS[view][4]
    piv = lambda w: " + ".join(f"(SELECT ln(v) FROM {w}{k - 1} WHERE i = {k} AND j = {k})" for k in range(1, n + 1))
    quad = " + ".join(f"(SELECT max(v) FILTER (j = 0) ** 2 / max(v) FILTER (j = {k}) FROM m{k - 1} WHERE i = {k})" for k in range(1, n + 1))
    k = "n" if mode == "raw" else "(SELECT count(*) FROM e)"
    ydot = "(SELECT sum(wt * ybar ** 2)" + (" + sum(ssw)" if mode == "raw" else "") + " FROM e)"
    log_weights = "(SELECT sum(ln(wt)) FROM e)" if mode == "effective" else "0"
    within = f"(SELECT (sum(T) - count(*)) * (2 * ln({t.sigma_eps!r}) + ln(0.5)) + sum(ssw) / {t.sigma_eps**2 * 0.5!r} FROM e)" if mode == "effective" else "0"
    return (
        base(view, mode, kind == "counts") + matrix_sql(kind, t) + eliminated(n, "q") + eliminated(n, "m") + f"""
SELECT {prefix}round(0.5 * (2 * {k} * ln({t.sigma_eps!r}) - {log_weights} + (SELECT sum(ln(m) - ln(q)) FROM pw) + {piv('m')} - ({piv('q')}) + {t.lam!r} * {ydot}
 - {t.lam**2!r} * ((SELECT sum(b ** 2 / m) FROM pw) + {quad}) + {within}), 6) AS {name} FROM st"""
    )


def add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        ORACLES[name] = sql


def _finite(s, d):
    df, n = load(s, d, "ue")
    df = df.withColumn("value", F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value")))
    return prepare.finite(prepare.working(df, **n)).select("firm", "worker", "y")


add("finite_filter", _finite, "SELECT event_type AS firm, user_id AS worker, value AS y FROM events WHERE value IS NOT NULL AND isfinite(value) AND event_id % 7 <> 0 AND event_id % 11 <> 0")


def _cap(s, d):
    df, n = load(s, d, "sp")
    return prepare.cap_degree(prepare.working(df, **n), 620).groupBy("firm").agg(F.count("*").alias("n_rows"), r6(F.sum("y") / 1e6).alias("y_sum"))


add("degree_cap", _cap, "WITH w AS (SELECT l_suppkey AS firm, l_partkey AS worker, l_extendedprice AS y FROM lineitem) SELECT firm, count(*) AS n_rows, round(sum(y) / 1e6, 6) AS y_sum FROM w WHERE firm IN (SELECT firm FROM w GROUP BY 1 HAVING count(*) <= 620) AND worker IN (SELECT worker FROM w GROUP BY 1 HAVING count(*) <= 620) GROUP BY 1")
add("standardize", lambda s, d: one(s, **{k: getattr(problem(s, d, "oc"), k) for k in ("n_rows",)}, **(lambda p: {"mean_k": p.y_mean / 1e5, "std_k": p.y_std / 1e5})(problem(s, d, "oc"))), base("oc") + "SELECT n AS n_rows, round(m / 1e5, 6) AS mean_k, round(s / 1e5, 6) AS std_k FROM st")
for _v in ("ue", "sp"):
    add(f"edge_collapse_{_v}", lambda s, d, v=_v: problem(s, d, v).edges.select("firm", "worker", F.col("T").alias("n_obs"), r6("ybar").alias("ybar"), r6("ssw").alias("ssw")), base(_v) + "SELECT firm, worker, T AS n_obs, round(ybar, 6) + 0.0 AS ybar, round(ssw, 6) + 0.0 AS ssw FROM e")
add("dense_index", lambda s, d: problem(s, d, "oc").workers.select("id", "idx"), base("oc") + "SELECT worker AS id, row_number() OVER (ORDER BY worker NULLS FIRST) - 1 AS idx FROM wn")
for _m in MODES:
    add(
        f"node_stats_{_m}",
        lambda s, d, m=_m: (lambda p: p.edges.groupBy("firm").agg(r6(F.sum("a")).alias("degree"), r6(F.sum("wt")).alias("cnt"), r6(F.sum(F.col("wt") * F.col("ybar"))).alias("projected")))(problem(s, d, "oc", "counts", m)),
        base("oc", _m, True) + "SELECT firm, round(d, 6) + 0.0 AS degree, round(c, 6) + 0.0 AS cnt, round(b, 6) + 0.0 AS projected FROM fn",
    )
    add(
        f"sufficient_stats_{_m}",
        lambda s, d, m=_m: (lambda x: one(s, k=int(x.k), ydot=float(x.ydot), log_weights=float(x.log_weights), within_ss=float(x.within_ss), within_df=int(x.within_df)))(problem(s, d, "oc", mode=m).sums),
        base("oc", _m) + f"SELECT CAST({'sum(T)' if _m == 'raw' else 'count(*)'} AS BIGINT) AS k, round(sum(wt * ybar ** 2){' + sum(ssw)' if _m == 'raw' else ''}, 6) AS ydot, round({'sum(ln(wt))' if _m == 'effective' else 'CAST(0 AS DOUBLE)'}, 6) + 0.0 AS log_weights, round({'sum(ssw)' if _m == 'effective' else 'CAST(0 AS DOUBLE)'}, 6) + 0.0 AS within_ss, CAST({'sum(T) - count(*)' if _m == 'effective' else '0'} AS BIGINT) AS within_df FROM e",
    )
add("edge_metadata", lambda s, d: problem(s, d, "oc").metadata().select("unique_edges", "duplicate_rows", r6("mean_edge_count").alias("mean_edge_count"), "max_edge_count", "total_prior_weight", "max_firm_degree", "max_worker_degree"), base("oc") + "SELECT count(*) AS unique_edges, CAST(sum(T) - count(*) AS BIGINT) AS duplicate_rows, round(avg(T), 6) AS mean_edge_count, max(T) AS max_edge_count, CAST(sum(a) AS DOUBLE) AS total_prior_weight, (SELECT CAST(max(d) AS DOUBLE) FROM fn) AS max_firm_degree, (SELECT CAST(max(d) AS DOUBLE) FROM wn) AS max_worker_degree FROM e")


def _ids(p, df, key="value"):
    """(side, idx, value) with ids instead of indices."""
    f = df.where("side = 'firm'").join(p.firms, "idx").select("side", F.col("id").cast("string").alias("id"), r6(key).alias("value"))
    return f.unionByName(df.where("side = 'worker'").join(p.workers, "idx").select("side", F.col("id").cast("string").alias("id"), r6(key).alias("value")))


NODE_VALUES = "SELECT 'firm' AS side, CAST(firm AS VARCHAR) AS id, round({f}, 6) + 0.0 AS value FROM pf UNION ALL SELECT 'worker', CAST(worker AS VARCHAR), round({w}, 6) + 0.0 FROM pw"


def _x(p, s):
    """A vector that both sides can make: firms 1 + idx % 7, workers 1 - idx % 5 / 4."""
    return p.firms.select(F.lit("firm").alias("side"), "idx", (1.0 + F.col("idx") % 7).alias("value")).unionByName(p.workers.select(F.lit("worker").alias("side"), "idx", (1 - F.col("idx") % 5 / 4).alias("value")))


XF, XW = "(1.0 + (i - 1) % 7)", "(1 - (row_number() OVER (ORDER BY worker NULLS FIRST) - 1) % 5 / 4.0)"
for _p in PRIORS:
    _cte = base("oc", counts=_p == "counts") + matrix_sql(_p)
    add(f"diagonal_q_{_p}", lambda s, d, k=_p: (lambda p: _ids(p, precision.diagonal(p, THETA)))(problem(s, d, "oc", k)), _cte + NODE_VALUES.format(f="q", w="q"))
    add(f"diagonal_m_{_p}", lambda s, d, k=_p: (lambda p: _ids(p, precision.diagonal(p, THETA, True)))(problem(s, d, "oc", k)), _cte + NODE_VALUES.format(f="m", w="m"))
    for _w, _post in (("q", False), ("m", True)):
        add(
            f"edges_{_w}_{_p}",
            lambda s, d, k=_p, post=_post: (lambda p: precision.off_diagonal(p, THETA, post).join(p.firms.select(F.col("idx").alias("f"), F.col("id").alias("firm")), "f").join(p.workers.select(F.col("idx").alias("w"), F.col("id").alias("worker")), "w").select("firm", "worker", r6(F.col("value") * 1.7).alias("value")))(problem(s, d, "oc", k)),
            _cte + f"SELECT firm, worker, round({_w} * 1.7, 6) + 0.0 AS value FROM c",
        )
        add(
            f"product_{_w}_{_p}",
            lambda s, d, k=_p, post=_post: (lambda p: _ids(p, precision.product(p, THETA, _x(p, s), post)))(problem(s, d, "oc", k)),
            _cte + f", xf AS (SELECT firm, {XF} AS x FROM pf), xw AS (SELECT worker, {XW} AS x FROM pw) " + NODE_VALUES.format(f=f"{_w} * (SELECT x FROM xf WHERE xf.firm = pf.firm) + (SELECT sum(c.{_w} * xw.x) FROM c JOIN xw USING (worker) WHERE c.firm = pf.firm)", w=f"{_w} * (SELECT x FROM xw WHERE xw.worker = pw.worker) + (SELECT sum(c.{_w} * xf.x) FROM c JOIN xf USING (firm) WHERE c.worker = pw.worker)"),
        )
for _v in ("ue", "oc", "sn"):
    for _p in ("normalized", "unnormalized"):
        for _m in MODES:
            add(f"nll_{_v}_{_p}_{_m}", lambda s, d, v=_v, k=_p, m=_m: one(s, nll=schur.likelihoods(problem(s, d, v, k, m), [THETA])[0]), nll_sql(_v, _p, _m))
# From tables alone: the Schur complement by a join, and the likelihood on it.
add("nll_event_user", lambda s, d: (lambda p: one(s, nll=schur.distributed_nll(p, THETA)))(problem(s, d, "ue")), ORACLES["nll_ue_normalized_raw"])
for _w, _post in (("q", False), ("m", True)):
    add(f"schur_pairs_{_w}", lambda s, d, post=_post: (lambda p: schur.schur_pairs(p, THETA, post).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), r6("value").alias("value")))(problem(s, d, "oc")), base("oc") + matrix_sql("normalized") + eliminated(5, _w) + f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 6) + 0.0 AS value FROM {_w}0 WHERE j >= i")
GRID = [-0.6, -0.3, 0.0, 0.3, 0.6]


def _profile(s, d):
    p = problem(s, d, "oc")
    found = schur.likelihoods(p, [Theta(r, 0.8, 0.5, 0.4) for r in GRID])
    return s.createDataFrame([(r, round(v, 6)) for r, v in zip(GRID, found, strict=True)], "rho double, nll double")


add("nll_rho_profile", _profile, " UNION ALL ".join(f"SELECT * FROM ({nll_sql('oc', 'normalized', 'raw', Theta(r, 0.8, 0.5, 0.4), prefix=f'CAST({r} AS DOUBLE) AS rho, ')})" for r in GRID))


def _target(s, d, t, m):
    p = problem(s, d, "oc", mode=m)
    g = decompose.target_of(p, t)
    n = decompose.residual(p, 1.0, g)
    return one(s, total=g.total, second_moment=g.second_moment / p.y_std**2, V_eta=float(n["V_eta"]), V_u=float(n["V_u"]), V_eps=float(n["V_eps"]))


for _m in MODES:
    for _t in ("estimation", "personyear", "edge"):
        _wt = {"estimation": WEIGHT_SQL[_m], "personyear": "T", "edge": "1.0"}[_t]
        _annual = _t == "personyear" or (_t == "estimation" and _m == "raw")
        _eta = 0.5 if _m == "effective" else 0.0
        _u = f"{1 - _eta}" + ("" if _annual else f" * sum(({_wt}) / T) / sum({_wt})")
        add(f"target_{_t}_{_m}", partial(_target, t=_t, m=_m), base("oc", _m) + f"SELECT round(CAST(sum({_wt}) AS DOUBLE), 6) AS total, round((sum(({_wt}) * ybar ** 2){' + sum(ssw)' if _annual else ''}) / sum({_wt}), 6) AS second_moment, CAST({_eta} AS DOUBLE) AS V_eta, round(CAST({_u} AS DOUBLE), 6) AS V_u, round(CAST({_eta} + {_u} AS DOUBLE), 6) AS V_eps FROM e")


def inverse_sql(n: int, w: str) -> str:
    """CTE inv(i, j, v): the inverse of the firms' Schur complement, by Gauss-Jordan on [S I]."""
    out = f""", g0 AS MATERIALIZED (SELECT i, j, v FROM {w}0 WHERE j > 0 UNION ALL SELECT i, i + {n}, 1.0 FROM pf UNION ALL SELECT x.i, y.i + {n}, 0.0 FROM pf x JOIN pf y ON x.i <> y.i)"""
    for k in range(1, n + 1):
        p = f"g{k - 1}"
        out += f""",
g{k} AS MATERIALIZED (SELECT s.i, s.j, CASE WHEN s.i = {k} THEN s.v / p.v ELSE s.v - a.v * b.v / p.v END AS v FROM {p} s JOIN {p} a ON a.i = s.i AND a.j = {k} JOIN {p} b ON b.i = {k} AND b.j = s.j JOIN {p} p ON p.i = {k} AND p.j = {k})"""
    return out + f", inv AS MATERIALIZED (SELECT i, j - {n} AS j, v FROM g{n} WHERE j > {n})"


def blocks_sql(w: str) -> str:
    """CTEs: vf, vw the inverse's diagonals, ve its edge entries."""
    return f""", sc AS MATERIALIZED (SELECT inv.i, c.worker, sum(inv.v * c.{w}) / any_value(c.w{w}) AS v FROM inv JOIN c ON c.i = inv.j GROUP BY 1, 2),
vf AS (SELECT pf.firm, pf.cnt, inv.v FROM inv JOIN pf ON pf.i = inv.i AND inv.j = inv.i),
ve AS (SELECT c.firm, c.worker, c.wt, -sc.v AS v FROM c JOIN sc ON sc.i = c.i AND sc.worker = c.worker),
vw AS (SELECT pw.worker, pw.cnt, 1 / pw.{w} + (SELECT sum(c.{w} * sc.v) / pw.{w} FROM c JOIN sc ON sc.i = c.i AND sc.worker = c.worker WHERE c.worker = pw.worker) AS v FROM pw)"""


MODE_SQL = """, mf AS MATERIALIZED (SELECT pf.firm, pf.i, pf.cnt, {lam} * sum(inv.v * r.v) AS v FROM pf JOIN inv ON inv.i = pf.i JOIN m0 r ON r.i = inv.j AND r.j = 0 GROUP BY 1, 2, 3),
mw AS MATERIALIZED (SELECT pw.worker, pw.cnt, ({lam} * pw.b - (SELECT sum(c.m * mf.v) FROM c JOIN mf ON mf.i = c.i WHERE c.worker = pw.worker)) / pw.m AS v FROM pw)""".format(lam=repr(THETA.lam))


def _shares(s, d, view, posterior):
    p = problem(s, d, view)
    x = (decompose.posterior_decomposition if posterior else decompose.prior_decomposition)(p, THETA)
    v = p.y_std**2
    return one(s, V_firm=x.V_firm / v, V_worker=x.V_worker / v, V_cross=x.V_cross / v, V_eps=x.V_eps / v, V_total=x.V_total / v)


for _v in ("ue", "oc", "sn"):
    _n = VIEWS[_v][4]
    _q = base(_v) + matrix_sql("normalized") + eliminated(_n, "q") + inverse_sql(_n, "q") + blocks_sql("q")
    _mm = base(_v) + matrix_sql("normalized") + eliminated(_n, "m") + inverse_sql(_n, "m") + blocks_sql("m") + MODE_SQL
    _sum = "SELECT round(a, 6) + 0.0 AS V_firm, round(z, 6) + 0.0 AS V_worker, round(x, 6) + 0.0 AS V_cross, round(u, 6) AS V_eps, round(a + z + x + u, 6) AS V_total FROM (SELECT {a} / n AS a, {z} / n AS z, 2 * {x} / n AS x, CAST(" + repr(THETA.sigma_eps**2) + " AS DOUBLE) AS u FROM st)"
    add(f"prior_decomposition_{_v}", partial(_shares, view=_v, posterior=False), _q + _sum.format(a="(SELECT sum(cnt * v) FROM vf)", z="(SELECT sum(cnt * v) FROM vw)", x="(SELECT sum(wt * v) FROM ve)"))
    add(f"posterior_decomposition_{_v}", partial(_shares, view=_v, posterior=True), _mm + _sum.format(a="((SELECT sum(cnt * v) FROM vf) + (SELECT sum(cnt * v ** 2) FROM mf))", z="((SELECT sum(cnt * v) FROM vw) + (SELECT sum(cnt * v ** 2) FROM mw))", x="((SELECT sum(wt * v) FROM ve) + (SELECT sum(c.wt * mf.v * mw.v) FROM c JOIN mf ON mf.i = c.i JOIN mw ON mw.worker = c.worker))"))
    add(f"posterior_mode_{_v}", lambda s, d, v=_v: (lambda p: _ids(p, decompose.mode_df(p, THETA, s), "mode"))(problem(s, d, v)), _mm + "SELECT 'firm' AS side, CAST(firm AS VARCHAR) AS id, round(v, 6) + 0.0 AS value FROM mf UNION ALL SELECT 'worker', CAST(worker AS VARCHAR), round(v, 6) + 0.0 FROM mw")
    for _w, _make, _s in (("prior", decompose.prior_covariance, _q), ("posterior", decompose.posterior_covariance, _mm)):
        add(
            f"covariance_firms_{_w}_{_v}",
            lambda s, d, v=_v, make=_make: (lambda p: make(p, THETA, "scaled").block(firms=[r["id"] for r in p.firms.orderBy("idx").collect()]).to_df(s).select("row_id", "col_id", r6("value").alias("value")))(problem(s, d, v)),
            _s + "SELECT CAST(x.firm AS VARCHAR) AS row_id, CAST(y.firm AS VARCHAR) AS col_id, round(inv.v, 6) + 0.0 AS value FROM inv JOIN pf x ON x.i = inv.i JOIN pf y ON y.i = inv.j",
        )
add(
    "covariance_rectangular",
    lambda s, d: (lambda p: decompose.posterior_covariance(p, THETA, "scaled").block(row_firms=[r["id"] for r in p.firms.orderBy("idx").collect()], col_workers=[1, 2, 3]).to_df(s).select("row_id", "col_id", r6("value").alias("value")))(problem(s, d, "sn")),
    base("sn") + matrix_sql("normalized") + eliminated(5, "m") + inverse_sql(5, "m") + blocks_sql("m") + "SELECT CAST(pf.firm AS VARCHAR) AS row_id, CAST(sc.worker AS VARCHAR) AS col_id, round(-sc.v, 6) + 0.0 AS value FROM sc JOIN pf ON pf.i = sc.i WHERE sc.worker IN (1, 2, 3)",
)
STEPS = 40
POWER_SQL = ", v0 AS MATERIALIZED (SELECT worker, 1.0 / sqrt(count(*) OVER ()) AS x FROM wn)" + "".join(f", u{k} AS MATERIALIZED (SELECT firm, sum(a * x) AS y FROM e JOIN v{k} USING (worker) GROUP BY 1), z{k} AS MATERIALIZED (SELECT worker, sum(a * y) AS x FROM e JOIN u{k} USING (firm) GROUP BY 1), v{k + 1} AS MATERIALIZED (SELECT worker, x / (SELECT sqrt(sum(x ** 2)) FROM z{k}) AS x FROM z{k})" for k in range(STEPS)) + f", s1 AS MATERIALIZED (SELECT sqrt(sqrt(sum(x ** 2))) AS s FROM z{STEPS - 1})"
add("singular_value", lambda s, d: one(s, value=precision.singular_value(problem(s, d, "oc"))), base("oc") + POWER_SQL + " SELECT round(s, 6) AS value FROM s1")
add("singular_value_tables", lambda s, d: one(s, value=precision.distributed_singular_value(problem(s, d, "oc"))), ORACLES["singular_value"])
for _w, _post in (("q", False), ("m", True)):
    add(
        f"edges_{_w}_spectral",
        lambda s, d, post=_post: (lambda p: precision.off_diagonal(p, THETA, post).join(p.firms.select(F.col("idx").alias("f"), F.col("id").alias("firm")), "f").join(p.workers.select(F.col("idx").alias("w"), F.col("id").alias("worker")), "w").select("firm", "worker", r6(F.col("value") * 1.7).alias("value")))(problem(s, d, "oc", SpectralPrior())),
        base("oc") + POWER_SQL + f" SELECT firm, worker, round(1.7 * ({-THETA.rho!r} / {THETA.sigma_a * THETA.sigma_z!r} * a / s" + (f" + {THETA.lam!r} * wt" if _post else "") + "), 6) + 0.0 AS value FROM e, s1",
    )
    add(f"diagonal_{_w}_spectral", lambda s, d, post=_post: (lambda p: _ids(p, precision.diagonal(p, THETA, post)))(problem(s, d, "oc", SpectralPrior())), base("oc") + matrix_sql("spectral") + NODE_VALUES.format(f=_w, w=_w))


def _pcg_mode_oc(s, d):
    p = problem(s, d, "oc")
    if p.tier == "parts":  # the same gradients on the complement of the larger side
        x = schur.complements(p, [(THETA, True)])[0]
        return _ids(p, decompose.mode_from(p, THETA, stochastic.pcg(x.schur.__matmul__, THETA.lam * x.rhs, np.diag(x.schur), 1e-12)[0], s), "mode")
    x, m = p.arrays, precision.posterior_matrix("normalized", p.arrays, THETA)
    return _ids(p, decompose.by_node(p, stochastic.pcg(m.__matmul__, THETA.lam * np.concatenate([x.bf, x.bw]), m.diagonal, 1e-12)[0], s), "mode")


add("pcg_mode_oc", _pcg_mode_oc, ORACLES["posterior_mode_oc"])
add("forest_logdet", lambda s, d: (lambda p: one(s, logdet=schur.logdet(dataclasses.replace(p, prior=VarianceStablePrior()), 0.6) / p.n_edges))(problem(s, d, "co")), base("co") + "SELECT round(((SELECT count(*) FROM fn) + (SELECT count(*) FROM wn) - count(*)) * ln(1 - 0.36) / count(*), 6) AS logdet FROM e")


# Graphs: suppliers and orders of the whole lineitem.  SQL spreads labels, peels and walks a fixed number of rounds, more than these graphs need.


def _lines(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").cast("long").alias("f"), F.col("l_orderkey").cast("long").alias("w"))


def _whole(s, d):
    return graph.adjacency(_lines(s, d))


ROUNDS = 12
OS = "WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS f, l_orderkey AS w FROM lineitem), adj AS MATERIALIZED (SELECT 2 * f AS u, 2 * w + 1 AS v FROM e UNION ALL SELECT 2 * w + 1, 2 * f FROM e)"
SPREAD = ", l0 AS MATERIALIZED (SELECT u AS node, min(least(u, v)) AS c FROM adj GROUP BY 1)" + "".join(f", l{k + 1} AS MATERIALIZED (SELECT adj.u AS node, least(min(o.c), min(n.c)) AS c FROM adj JOIN l{k} n ON n.node = adj.v JOIN l{k} o ON o.node = adj.u GROUP BY 1)" for k in range(ROUNDS)) + f", labels AS (SELECT node, c AS component FROM l{ROUNDS})"
PEEL = "".join(f", p{k} AS MATERIALIZED (SELECT * FROM {x} WHERE u IN (SELECT u FROM {x} GROUP BY 1 HAVING count(*) >= 2) AND v IN (SELECT u FROM {x} GROUP BY 1 HAVING count(*) >= 2))" for k, x in enumerate(["adj", *(f"p{i}" for i in range(ROUNDS))]))
add("components", lambda s, d: graph.components(_whole(s, d)).select(F.col("node").cast("long").alias("node"), F.col("component").cast("long").alias("component")), OS + SPREAD + " SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM labels")
add("circuit_rank", lambda s, d: (lambda r: one(s, rank=int(r), forest=r == 0))(graph.circuit_rank(_whole(s, d))), OS + SPREAD + " SELECT CAST(r AS BIGINT) AS rank, r = 0 AS forest FROM (SELECT (SELECT count(*) FROM e) - count(*) + count(DISTINCT component) AS r FROM labels)")
add("two_core", lambda s, d: graph.two_core(_whole(s, d)).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), OS + PEEL + f" SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM p{ROUNDS}")
add("distance_to_core", lambda s, d: (lambda a: graph.distance_to_core(a, graph.two_core(a)).select(F.col("node").cast("long").alias("node"), F.col("distance").cast("long").alias("distance")))(_whole(s, d)), OS + PEEL + f", walk(node, k) AS (SELECT DISTINCT u, 0 FROM p{ROUNDS} UNION SELECT adj.v, walk.k + 1 FROM walk JOIN adj ON adj.u = walk.node WHERE walk.k < {ROUNDS}) SELECT CAST(a.u AS BIGINT) AS node, CAST(coalesce(min(walk.k), -1) AS BIGINT) AS distance FROM (SELECT DISTINCT u FROM adj) a LEFT JOIN walk ON walk.node = a.u GROUP BY 1")


def _nb(s, d):
    x = graph.nb_spectrum(_lines(s, d))
    return one(s, radius=float(x.radius), binding=int(x.binding), circuit_rank=int(x.circuit_rank), ceiling=graph.ceiling(x.radius), recommended=graph.guarded_limit(x.radius))


add("nb_spectrum", _nb)
add("feasibility", lambda s, d: (lambda r: one(s, **{k: (float(v) if isinstance(v, float) else v) for k, v in r.items()}))(graph.feasibility(problem(s, d, "ue", VarianceStablePrior("auto")))))
add("pcg_mode", lambda s, d: (lambda x: one(s, ok=x[0], norm=x[1]))(stochastic.mode_norm(problem(s, d, "sp"), THETA, 1e-10)))
add("slq_nll", lambda s, d: one(s, nll=stochastic.stochastic_likelihood(problem(s, d, "sp"), THETA, HutchSLQ(), spark=s)))
add("hutchinson_prior", lambda s, d: decompose.prior_decomposition(problem(s, d, "oc"), THETA, probes=200, spark=s).to_df(s))
add("fit_exact", lambda s, d: fit(*(lambda x: (x[0],))(load(s, d, "ue")), fix_rho=0.25, **load(s, d, "ue")[1]).to_df(s))
add("fit_stochastic", lambda s, d: solve(problem(s, d, "sn", SpectralPrior()), HutchSLQ(), fix_rho=0.25).to_df(s))
add("fit_suppliers", lambda s, d: solve(problem(s, d, "sp"), ExactCholesky()).to_df(s))
