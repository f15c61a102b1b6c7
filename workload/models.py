"""Model fits, fit tables, artefacts and posterior draws."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarea.operators import draws as dr
from tessarea.operators import model as mo
from tessarea.operators import smoothing as sm
from tessarea.operators.graph import drop_islands, envelope
from tessarea.operators.smoothing import TOL
from tessarea.plans import levels as lv
from tessarea.plans.levels import MEDIAN_VARIANCES, Study, run_study, study_frames
from tessarea.session import cut_lineage, scratch_path
from tessarea.sources import read_fit, read_table, write_fit, write_text_table

from .oracle import LEVEL_KEYS
from .registry import query, r
from .tables import Tables

DRAW_KEYS = ("level", "variant", "param", "idx")
_KEYS = ", ".join(DRAW_KEYS)


@query(
    "poisson_rates",
    f"""SELECT '(Intercept)' AS term, {r("ln(sum(observed) / sum(expected))")} AS estimate FROM t_mesh_frame""",
)
def poisson_rates(t: Tables):
    return mo.poisson_rates(t.mesh_frame)


_BY_QUINTILE = f"""
WITH q AS (SELECT quintile, ln(sum(observed) / sum(expected)) AS b FROM t_mesh_frame GROUP BY quintile),
l AS (SELECT min(quintile) AS q0 FROM q)
SELECT CASE WHEN quintile = q0 THEN '(Intercept)' ELSE 'quintile' || CAST(quintile AS VARCHAR) END AS term,
       {r("CASE WHEN quintile = q0 THEN b ELSE b - (SELECT b FROM q WHERE quintile = q0) END")} AS estimate
FROM q CROSS JOIN l"""


@query("poisson_rates_by_quintile", _BY_QUINTILE)
def poisson_rates_by_quintile(t: Tables):
    return mo.poisson_rates(t.mesh_frame, "quintile")


@query("poisson_glm", _BY_QUINTILE)
def poisson_glm(t: Tables):
    return mo.poisson_glm(t.stored_frame, ["quintile"])


DESIGN_STEPS = 25


def _design_sql() -> str:
    """With all interactions each class has its own line: Newton steps for its slope, its level in closed form."""
    parts = [
        """f AS MATERIALIZED (SELECT quintile AS q, observed AS o, expected AS e, (MB_CODE16 % 50) / 50e0 AS x FROM t_mesh_frame)""",
        "n0 AS (SELECT DISTINCT q, 0e0 AS c FROM f)",
    ]
    sums = "sum(o) AS o, sum(o * x) AS ox, sum(e * exp(c * x)) AS s0, sum(e * exp(c * x) * x) AS s1, sum(e * exp(c * x) * x * x) AS s2"
    for k in range(DESIGN_STEPS):
        parts.append(
            f"""n{k + 1} AS MATERIALIZED (SELECT q, c + (ox - o * s1 / s0) / (o * (s2 / s0 - (s1 / s0) * (s1 / s0))) AS c
  FROM (SELECT q, c, {sums} FROM f JOIN n{k} USING (q) GROUP BY q, c) s)"""
        )
    parts.append(
        f"l AS MATERIALIZED (SELECT q, c, ln(sum(o) / sum(e * exp(c * x))) AS b FROM f JOIN n{DESIGN_STEPS} USING (q) GROUP BY q, c)"
    )
    parts.append("low AS (SELECT c AS c0, b AS b0, q AS q0 FROM l ORDER BY q LIMIT 1)")
    name = "'quintile' || CAST(q AS VARCHAR)"
    return f"""WITH {", ".join(parts)}
SELECT CASE WHEN q = q0 THEN '(Intercept)' ELSE {name} END AS term, {r("CASE WHEN q = q0 THEN b ELSE b - b0 END")} AS estimate FROM l, low
UNION ALL SELECT CASE WHEN q = q0 THEN 'easting' ELSE {name} || ':easting' END, {r("CASE WHEN q = q0 THEN c ELSE c - c0 END")} FROM l, low"""


@query("poisson_design", _design_sql())
def poisson_design(t: Tables):
    """A trend from west to east that differs by deprivation class."""
    frame = t.stored_frame.withColumn("easting", (F.col("MB_CODE16") % 50) / 50)
    return mo.poisson_design(frame, ["quintile"], ["easting"], [("quintile", "easting")])


def bym_sql(frame: str, edges: str, select: str, tol: float = TOL) -> str:
    """Newton steps with conjugate gradients as a recursion, then ``select``.

    ``frame`` has level, variant, area, o, e, q, tau2, sigma2. A recursion step is one
    product with the edges; rows carry the scalars of their model and class along.
    """
    key = "level, variant"
    static = f"{key}, area, o, e, q, tau2, sigma2, n"
    mu = "(e * exp(beta + phi + theta))"
    w = f"({mu} / (1 + {mu} * sigma2))"
    g = f"(o - {mu} - theta / sigma2)"
    rhs = f"(o - {mu} - {w} * sigma2 * {g})"
    scale = f"({w} + n / tau2)"
    dtheta = f"(({g} - {mu} * (x + xb)) / ({mu} + 1 / sigma2))"
    lap_x = f"(tau2 * ({rhs} - lap / tau2 - r - {w} * (x + xb)))"

    def objective(t: float) -> str:
        eta = f"(beta + {t} * xb + phi + {t} * x + theta + {t} * {dtheta})"
        return (
            f"sum(o * (ln(e) + {eta}) - e * exp({eta}) - (phi + {t} * x) * (lap + {t} * {lap_x}) / (2 * tau2)"
            f" - (theta + {t} * {dtheta}) * (theta + {t} * {dtheta}) / (2 * sigma2))"
        )

    lengths = sm.STEP_LENGTHS
    objectives = ", ".join(f"{objective(t)} AS j{k}" for k, t in enumerate((0.0, *lengths)))
    totals = ", ".join(f"sum(j{k}) AS j{k}" for k in range(len(lengths) + 1))
    floor = f"(j0 - {sm.SLACK!r} * abs(j0))"
    length = "CASE " + " ".join(f"WHEN j{k} >= {floor} THEN CAST({t} AS DOUBLE)" for k, t in enumerate(lengths, 1))
    length += f" ELSE CAST({lengths[-1]} AS DOUBLE) END"
    length_m = length.replace(" j", " cm.j").replace("(j", "(cm.j")
    z = "CAST(0 AS DOUBLE)"
    return f"""SELECT * FROM (WITH RECURSIVE fr AS MATERIALIZED ({frame}),
ed AS MATERIALIZED ({edges}),
st AS (SELECT 0 AS k, 0 AS step, true AS moves, false AS settled, {key}, area, o, e, q, tau2, sigma2, CAST(n AS DOUBLE) AS n,
         {z} AS beta, {z} AS phi, {z} AS theta, {z} AS lap, {z} AS x, {z} AS r, {z} AS p, {z} AS s, {z} AS v,
         {z} AS xb, {z} AS rb, {z} AS pb, {z} AS sb, {z} AS wb, {z} AS vb, {z} AS f1, {z} AS f2, CAST(NULL AS DOUBLE) AS g1,
         CAST(NULL AS DOUBLE) AS g0, CAST(NULL AS DOUBLE) AS a0,
         ln(greatest(sum(o) OVER (PARTITION BY {key}, q), {sm.ZERO_CASES}) / sum(e) OVER (PARTITION BY {key}, q)) AS beta_next,
         {z} AS objective, {z} AS gradient
       FROM fr JOIN (SELECT {key}, src AS area, count(*) AS n FROM ed GROUP BY {key}, src) d USING ({key}, area)
  UNION ALL
  (WITH b AS MATERIALIZED (SELECT *, {scale} AS sc FROM st WHERE NOT settled AND k < 20000),
   c1 AS MATERIALIZED (SELECT k, step, moves, {static}, f1, f2, g1, g0, a0, wb, vb, sc,
     CASE WHEN moves THEN beta_next ELSE beta END AS beta,
     CASE WHEN moves THEN phi + f1 * x - f2 ELSE phi END AS phi,
     CASE WHEN moves THEN theta + f1 * {dtheta} ELSE theta END AS theta, lap,
     CASE WHEN moves THEN 0 ELSE r / sc + f2 * p END AS p, CASE WHEN moves THEN 0 ELSE v + f2 * s END AS s,
     CASE WHEN moves THEN 0 ELSE rb / wb + f2 * pb END AS pb, CASE WHEN moves THEN 0 ELSE vb + f2 * sb END AS sb,
     x, r, xb, rb FROM b),
   c2 AS MATERIALIZED (SELECT * EXCLUDE (x, r, xb, rb),
     CASE WHEN moves THEN 0 ELSE x + f1 * p END AS x, CASE WHEN moves THEN 0 ELSE r - f1 * s END AS r,
     CASE WHEN moves THEN 0 ELSE xb + f1 * pb END AS xb, CASE WHEN moves THEN 0 ELSE rb - f1 * sb END AS rb FROM c1),
   c3 AS MATERIALIZED (SELECT *, CASE WHEN moves THEN phi ELSE r / sc END AS msg FROM c2),
   nb AS MATERIALIZED (SELECT ed.level, ed.variant, src AS area, sum(msg) AS around FROM ed JOIN c3 t
          ON ed.level = t.level AND ed.variant = t.variant AND dst = t.area GROUP BY ed.level, ed.variant, src),
   c4 AS MATERIALIZED (SELECT c3.* EXCLUDE (lap), CASE WHEN moves THEN n * msg - around ELSE lap END AS lap,
     n * msg - around AS spread FROM c3 JOIN nb USING ({key}, area)),
   c5 AS MATERIALIZED (SELECT * EXCLUDE (r, spread), CASE WHEN moves THEN {rhs} - lap / tau2 ELSE r END AS r,
     CASE WHEN moves THEN 0 ELSE {w} * (msg + rb / wb) + spread / tau2 END AS v FROM c4),
   cl AS MATERIALIZED (SELECT {key}, q, sum({w}) AS cw, sum({rhs}) AS crb, sum({g} * {g}) AS gt,
     sum((o - {mu} - lap / tau2) * (o - {mu} - lap / tau2)) AS gp, sum(o - {mu}) AS gap, sum(r * (r / {scale})) AS ru,
     sum(r / {scale} * v) AS uv, sum({w} * (r / {scale})) AS wu, sum(phi) AS sphi, sum(x) AS sx, count(*) AS rws,
     max(rb) AS orb, max(wb) AS owb, {objectives} FROM c5 GROUP BY {key}, q),
   cm AS MATERIALIZED (SELECT {key}, sqrt(sum(gt + gp + gap * gap)) AS gradient, sum(sphi) AS sphi, sum(sx) AS sx, sum(rws) AS rws, {totals},
     sum(ru) + sum(orb * orb / nullif(owb, 0)) AS gam, sum(uv) + sum((wu + orb) * orb / nullif(owb, 0)) AS del FROM cl GROUP BY {key}),
   dc AS MATERIALIZED (SELECT c5.*, cw, crb, wu, gam, del, cm.gradient, cm.j0, {length_m} AS len, cm.sphi, cm.sx, cm.rws,
     NOT moves AND gam <= {sm.FORCING**2!r} * coalesce(g1, gam) AS ends
     FROM c5 JOIN cl USING ({key}, q) JOIN cm USING ({key})),
   sc AS MATERIALIZED (SELECT *, coalesce(gam / g0, 0) AS bc, gam / (del - coalesce(gam / g0 * gam / a0, 0)) AS al,
     (sphi + len * sx) / rws AS centre FROM dc)
   SELECT k + 1, CASE WHEN moves THEN step + 1 ELSE step END, CASE WHEN moves THEN false ELSE ends END, moves AND gradient < {tol!r},
     {static}, beta, phi, theta, lap, x, r, p, s, v, xb, CASE WHEN moves THEN crb ELSE rb END, pb, sb,
     CASE WHEN moves THEN cw ELSE wb END, CASE WHEN moves THEN 0 ELSE wu + rb END,
     CASE WHEN moves THEN 0 WHEN ends THEN len ELSE al END, CASE WHEN moves THEN 0 WHEN ends THEN centre ELSE bc END,
     CASE WHEN moves OR ends THEN NULL ELSE coalesce(g1, gam) END, CASE WHEN moves OR ends THEN NULL ELSE gam END,
     CASE WHEN moves OR ends THEN NULL ELSE al END,
     CASE WHEN moves THEN beta ELSE beta + len * xb + centre END, j0, gradient FROM sc)),
fitted AS (SELECT *, {mu} AS mu FROM st WHERE settled),
tr AS (SELECT {key}, CAST(step - 1 AS INTEGER) AS step, max(objective) AS objective, CAST(k AS INTEGER) AS products
       FROM (SELECT *, lag(moves) OVER (PARTITION BY {key}, area ORDER BY k) AS moved FROM st) m WHERE moved GROUP BY {key}, step, k)
{select}) settled_x"""


TAU2, SIGMA2 = 0.08, 0.0013
_ONE = f"""SELECT 'Mesh' AS level, 'nc' AS variant, MB_CODE16 AS area, observed AS o, expected AS e, '' AS q,
  CAST({TAU2} AS DOUBLE) AS tau2, CAST({SIGMA2} AS DOUBLE) AS sigma2
FROM t_mesh_frame WHERE MB_CODE16 IN (SELECT src FROM t_mesh_edges WHERE dst IN (SELECT MB_CODE16 FROM t_mesh_frame))"""
# Only edges between areas of the frame.
_ONE_EDGES = """SELECT 'Mesh' AS level, 'nc' AS variant, src, dst FROM t_mesh_edges
WHERE src IN (SELECT MB_CODE16 FROM t_mesh_frame) AND dst IN (SELECT MB_CODE16 FROM t_mesh_frame)"""


def settled(fit: mo.BymFit) -> mo.BymFit:
    """The fit, unless the guard ended it before the tolerance did."""
    if not fit.settled:
        raise RuntimeError("the smoothing model has not settled")
    return fit


def mesh_bym(t: Tables, covariate: str | None = None) -> mo.BymFit:
    edges = cut_lineage(t.mesh_edges, "edges")
    frame = drop_islands(t.stored_frame, edges, "MB_CODE16")
    return settled(mo.bym_map(frame, edges, TAU2, SIGMA2, area="MB_CODE16", covariate=covariate))


@query(
    "bym_map",
    bym_sql(
        _ONE,
        _ONE_EDGES,
        f"""SELECT area AS MB_CODE16, {r("o")} AS observed, {r("e")} AS expected, {r("beta")} AS beta, {r("phi")} AS phi,
      {r("theta")} AS theta, {r("mu")} AS fitted FROM fitted""",
    ),
)
def bym_map(t: Tables):
    return mesh_bym(t).areas


@query(
    "bym_trace",
    bym_sql(
        _ONE.replace("'' AS q", "CAST(quintile AS VARCHAR) AS q"),
        _ONE_EDGES,
        f"SELECT step, {r('objective')} AS objective, products FROM tr",
    ),
)
def bym_trace(t: Tables):
    """The gradient is left out: it is rounding noise at the end."""
    return mesh_bym(t, "quintile").trace.drop("gradient")


_VARIANCES = ", ".join(f"('{lv}', '{va}', {a}, {b})" for lv, va, a, b in MEDIAN_VARIANCES)
_ALL = f"""SELECT f.level, f.variant, area, observed AS o, expected AS e, coalesce(CAST(quintile AS VARCHAR), '') AS q,
  CAST(tau2 AS DOUBLE) AS tau2, CAST(sigma2 AS DOUBLE) AS sigma2
FROM t_frames f JOIN (VALUES {_VARIANCES}) v(level, variant, tau2, sigma2) ON f.level = v.level AND f.variant = v.variant"""

_ALL_EDGES = "SELECT level, variant, src, dst FROM t_edges"


def settled_study(t: Tables) -> Study:
    study = run_study(t)
    settled(study.fit)
    return study


@query(
    "fit_all_levels",
    bym_sql(
        _ALL,
        _ALL_EDGES,
        f"""SELECT level, variant, area, {r("o")} AS observed, {r("e")} AS expected, {r("beta")} AS beta,
      {r("phi")} AS phi, {r("theta")} AS theta, {r("mu")} AS fitted, {r("mu / e")} AS fitted_sir,
      {r("(o - mu) / sqrt(mu)")} AS residual FROM fitted""",
    ),
)
def fit_all_levels(t: Tables):
    return settled_study(t).fitted().drop("quintile")


@query("fitted_sir", f"SELECT MB_CODE16, {r('fitted / expected')} AS fitted_sir FROM t_fit")
def fitted_sir(t: Tables):
    return mo.fitted_sir(t.fit).select("MB_CODE16", "fitted_sir")


@query(
    "residuals",
    f"""SELECT MB_CODE16, {r("observed - fitted")} AS response, {r("(observed - fitted) / sqrt(fitted)")} AS pearson FROM t_fit""",
)
def residuals(t: Tables):
    both = mo.residual_table(mo.residual_table(t.fit, "response", "response"), "pearson", "pearson")
    return both.select("MB_CODE16", "response", "pearson")


@query(
    "observed_fitted",
    f"""SELECT MB_CODE16, {r("f.observed")} AS observed, {r("fitted")} AS fitted FROM t_mesh_frame f JOIN t_fit USING (MB_CODE16)""",
)
def observed_fitted(t: Tables):
    return mo.observed_fitted(t.stored_frame, t.fit, "MB_CODE16")


@query(
    "fit_roundtrip",
    f"""SELECT level, variant, MB_CODE16, {r("fitted")} AS fitted
FROM (SELECT 'Mesh' AS level, 'wc' AS variant, MB_CODE16, fitted FROM t_fit) x""",
)
def fit_roundtrip(t: Tables):
    """Two variants are written; the partition filter reads one of them back."""
    path = scratch_path(t.spark, "fit")
    fit = t.fit.select("MB_CODE16", "fitted", F.lit("Mesh").alias("level"))
    both = reduce(
        DataFrame.unionByName, [fit.withColumn("variant", F.lit(v)) for v in ("nc", "wc")]
    )
    write_fit(both, path)
    return read_fit(t.spark, path, "Mesh", "wc").select("level", "variant", "MB_CODE16", "fitted")


def _fitted_layers_sql() -> str:
    fitted = bym_sql(_ALL, _ALL_EDGES, "SELECT level, variant, area, mu / e AS ratio FROM fitted")
    raw, boxes = [], []
    for short, (level, key) in LEVEL_KEYS.items():
        raw.append(f"""SELECT '{level}' AS level, CAST({key} AS BIGINT) AS area, "count" / nullif(expect, 0) AS raw FROM t_{short}_counts""")
        boxes.append(f"SELECT '{level}' AS level, CAST(area AS BIGINT) AS area, min(x) AS xmin, max(y) AS ymax FROM t_{short}_points GROUP BY area")
    shown = "coalesce(ratio, raw)"
    return f"""SELECT * FROM (WITH fits AS MATERIALIZED ({fitted}), raw AS ({" UNION ALL ".join(raw)}), box AS ({" UNION ALL ".join(boxes)})
SELECT level, variant, CAST(upper AS DOUBLE) AS upper, area, {r(f"CASE WHEN {shown} BETWEEN 0 AND upper THEN {shown} END")} AS sir,
  {r("xmin")} AS xmin, {r("ymax")} AS ymax
FROM raw CROSS JOIN (VALUES ('nc'), ('wc')) v(variant) CROSS JOIN (VALUES (1.6), (2.0)) u(upper)
LEFT JOIN fits USING (level, variant, area) JOIN box USING (level, area)) maps"""


@query("fitted_layers", _fitted_layers_sql())
def fitted_layers(t: Tables):
    """The ten smoothed fits saved one by one, read back, and drawn at both scales."""
    path = scratch_path(t.spark, "fits")
    fitted = cut_lineage(settled_study(t).fitted(), "fitted").select("level", "variant", "area", "fitted", "expected")
    for level, variant in _SAVED:
        write_fit(fitted.where((F.col("level") == level) & (F.col("variant") == variant)), path)
    saved = reduce(DataFrame.unionByName, [read_fit(t.spark, path, level, variant) for level, variant in _SAVED])
    xmin, _, _, ymax = envelope()
    shown = lv.fitted_layers(t, t.sa2, saved)
    return shown.select("level", "variant", "upper", "area", "sir", xmin.alias("xmin"), ymax.alias("ymax"))


_SAVED = [(level, variant) for level, variant, *_ in MEDIAN_VARIANCES]


@query(
    "fits_one_by_one",
    "SELECT level, variant, area, " + r("observed * CASE WHEN level = 'SA2' AND variant = 'nc' THEN 2 ELSE 1 END") + " AS fitted FROM t_frames",
)
def fits_one_by_one(t: Tables):
    """The tables of all ten models saved one after the other, one of them again, all read back."""
    path = scratch_path(t.spark, "fits")
    frames = cut_lineage(study_frames(t, t.sa2), "frames").select("level", "variant", "area", F.col("observed").alias("fitted"))
    for level, variant in _SAVED:
        write_fit(frames.where((F.col("level") == level) & (F.col("variant") == variant)), path)
    again = frames.where("level = 'SA2' AND variant = 'nc'").withColumn("fitted", 2 * F.col("fitted"))
    write_fit(again, path)
    parts = [read_fit(t.spark, path, level, variant) for level, variant in _SAVED]
    return reduce(DataFrame.unionByName, parts).select("level", "variant", "area", "fitted")


@query(
    "text_roundtrip",
    f"""SELECT sa2, sa2_name, sex, site10group, {r('"count"')} AS "count", {r("expect")} AS expect FROM t_cases""",
)
def text_roundtrip(t: Tables):
    """The cases written as text and scanned with an explicit schema."""
    path = scratch_path(t.spark, "cases")
    write_text_table(t.cases, path)
    schema = "sa2 bigint, sa2_name string, sex string, site10group int, count double, expect double"
    return read_table(t.spark, path, schema, sep=" ")


BURNIN, THIN = 100, 10
_THINNED = f"SELECT * FROM t_draws WHERE iter > {BURNIN} AND (iter - {BURNIN}) % {THIN} = 0"


@query("thin_draws", f"SELECT level, variant, param, idx, iter, {r('value')} AS value FROM ({_THINNED}) x")
def thin_draws(t: Tables):
    return dr.thin_draws(t.draws, BURNIN, THIN)


def _summary_sql(source: str) -> str:
    cuts = ", ".join(
        f"{r(f'quantile_cont(value, {p})')} AS {name}" for name, p in dr.SUMMARY.items()
    )
    return f"""SELECT {_KEYS}, count(value) AS n_draws, {r("avg(value)")} AS mean, {r("stddev_samp(value)")} AS sd,
  {r("stddev_samp(value) / sqrt(count(value))")} AS naive_se, {cuts} FROM {source} GROUP BY {_KEYS}"""


@query("posterior_summary", _summary_sql("t_draws"))
def posterior_summary(t: Tables):
    return dr.posterior_summary(t.draws)


@query("posterior_summary_thinned", _summary_sql(f"({_THINNED}) x"))
def posterior_summary_thinned(t: Tables):
    return dr.posterior_summary(dr.thin_draws(t.draws, BURNIN, THIN))


BATCHES = 20


@query(
    "mixing",
    f"""WITH b AS (SELECT {_KEYS}, floor((iter - lo) / CAST(hi - lo + 1 AS DOUBLE) * {BATCHES}) AS b,
        count(*) AS n, avg(value) AS m
   FROM t_draws JOIN (SELECT level AS lv, min(iter) AS lo, max(iter) AS hi FROM t_draws GROUP BY level) s ON level = lv
   GROUP BY {_KEYS}, b),
g AS (SELECT {_KEYS}, sqrt(var_samp(m) / count(*)) AS mcse, count(*) AS n_batches,
        sum(n * m) FILTER (WHERE b < {BATCHES / 10}) / sum(n) FILTER (WHERE b < {BATCHES / 10}) AS early,
        sum(n * m) FILTER (WHERE b >= {BATCHES / 2}) / sum(n) FILTER (WHERE b >= {BATCHES / 2}) AS late,
        var_samp(m) FILTER (WHERE b < {BATCHES / 10}) / count(*) FILTER (WHERE b < {BATCHES / 10})
        + var_samp(m) FILTER (WHERE b >= {BATCHES / 2}) / count(*) FILTER (WHERE b >= {BATCHES / 2}) AS err2
   FROM b GROUP BY {_KEYS})
SELECT {_KEYS}, n_draws, n_batches, {r("mcse")} AS mcse, {r("var / (mcse * mcse)")} AS ess, {r("(early - late) / sqrt(err2)")} AS geweke_z
FROM g JOIN (SELECT level AS lv, count(value) AS n_draws, var_samp(value) AS var FROM t_draws GROUP BY level) v ON level = lv""",
)
def mixing(t: Tables):
    return dr.mixing(t.draws, BATCHES).withColumn("n_draws", F.col("n_draws").cast("bigint"))


@query("trace", f"SELECT level, variant, param, idx, iter, {r('value')} AS value FROM t_draws")
def trace(t: Tables):
    return dr.trace(t.draws)


BINS = 32


@query(
    "density_bins",
    f"""SELECT {_KEYS}, CAST(least(floor((value - lo) / ((hi - lo) / {BINS})) + 1, {BINS}) AS INTEGER) AS bin,
  {r(f"max(lo) + max((hi - lo) / {BINS}) * (least(floor((value - lo) / ((hi - lo) / {BINS})) + 1, {BINS}) - CAST(0.5 AS DOUBLE))")} AS midpoint,
  count(*) AS n_draws, {r(f"count(*) / (max(n) * max((hi - lo) / {BINS}))")} AS density
FROM t_draws JOIN (SELECT level AS lv, min(value) AS lo, max(value) AS hi, count(value) AS n FROM t_draws GROUP BY level) s ON level = lv
GROUP BY {_KEYS}, least(floor((value - lo) / ((hi - lo) / {BINS})) + 1, {BINS})""",
)
def density_bins(t: Tables):
    return dr.density_bins(t.draws, BINS)


CRITERIA_SQL = f"""WITH a AS (SELECT MB_CODE16, observed AS o, avg(ll) AS mean_ll, var_samp(ll) AS var_ll, ln(avg(exp(ll))) AS lppd,
        ln(avg(exp(-ll))) AS inv, avg(fitted) AS mu
   FROM (SELECT MB_CODE16, observed, fitted, observed * ln(fitted) - fitted - lgamma(observed + 1) AS ll
         FROM t_draw_fits JOIN t_mesh_frame USING (MB_CODE16)) x GROUP BY MB_CODE16, observed),
s AS (SELECT -2 * sum(mean_ll) AS dbar, -2 * sum(o * ln(mu) - mu - lgamma(o + 1)) AS dhat, sum(lppd) AS lppd,
        sum(var_ll) AS p_waic, -sum(inv) AS lmpl FROM a)
SELECT {r("2 * dbar - dhat")} AS dic, {r("dbar - dhat")} AS p_dic, {r("-2 * (lppd - p_waic)")} AS waic, {r("p_waic")} AS p_waic,
  {r("lmpl")} AS lmpl FROM s"""


@query("fit_criteria", CRITERIA_SQL)
def fit_criteria(t: Tables):
    return dr.fit_criteria(t.draw_fits, t.stored_frame, "MB_CODE16")


@query("chain_criteria", CRITERIA_SQL)
def chain_criteria(t: Tables):
    """The same from three chains' stored states, the draws of none read twice."""
    chains = [t.draw_fits.where(F.col("iter") % 3 == k) for k in range(3)]
    states = [cut_lineage(dr.criteria_state(c, t.stored_frame, "MB_CODE16"), "state") for c in chains]
    return dr.criteria_of(dr.merge_criteria(states, "MB_CODE16"), "MB_CODE16")


RELATIVE = 1e-3
_CELL = f"""CASE WHEN value = 0 THEN 0 ELSE CAST(sign(value) AS BIGINT) *
  (CAST(ceil(ln(abs(value)) / {math.log1p(RELATIVE)!r}::DOUBLE) AS BIGINT) + {dr.CELL_ZERO}) END"""


def _cells_sql() -> str:
    cuts = ", ".join(
        f"{r(f'min(struct_pack(c := cell, m := mean)) FILTER (WHERE upto >= floor({p}::DOUBLE * (n_all - 1)) + 1).m')} AS {name}"
        for name, p in dr.SUMMARY.items()
    )
    return f"""WITH cells AS (SELECT {_KEYS}, {_CELL} AS cell, count(*) AS n, avg(value) AS mean FROM t_draws WHERE value IS NOT NULL GROUP BY {_KEYS}, cell),
w AS (SELECT *, sum(n) OVER (PARTITION BY {_KEYS} ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {_KEYS}) AS n_all FROM cells),
q AS (SELECT {_KEYS}, {cuts} FROM w GROUP BY {_KEYS})
SELECT q.*, n_draws, {r("mean")} AS mean, {r("sd")} AS sd, {r("sd / sqrt(n_draws)")} AS naive_se
FROM q JOIN (SELECT {_KEYS}, count(value) AS n_draws, avg(value) AS mean, stddev_samp(value) AS sd FROM t_draws GROUP BY {_KEYS}) m USING ({_KEYS})"""


@query("chain_summary", _cells_sql())
def chain_summary(t: Tables):
    """Two chains, the second merged into the stored state of the first."""
    states = [cut_lineage(dr.summary_state(t.draws.where(F.col("iter") % 2 == k)), "state") for k in (0, 1)]
    return dr.summary_of(dr.merge_summaries(states))


@query(
    "interval_table",
    f"""SELECT level, parameter, {r("m")} AS median, {r("lo")} AS lower, {r("hi")} AS upper, lo <= m AND m <= hi AS consistent
FROM (SELECT level, 'value' AS parameter, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.025) AS lo,
             quantile_cont(value, 0.975) AS hi FROM t_draws GROUP BY level
      UNION ALL
      SELECT level, 'mean', avg(value), avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)),
             avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)) FROM t_draws GROUP BY level) x""",
)
def interval_table(t: Tables):
    """Intervals of the draws and of their mean, from one wide summary row per level."""
    wide = dr.posterior_summary(t.draws).withColumns(
        {
            "mean_lower": F.col("mean") - 1.96 * F.col("naive_se"),
            "mean_upper": F.col("mean") + 1.96 * F.col("naive_se"),
        }
    )
    return dr.interval_table(
        wide,
        "level",
        {"value": ("q50", "q025", "q975"), "mean": ("mean", "mean_lower", "mean_upper")},
    )
