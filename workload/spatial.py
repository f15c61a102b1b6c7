"""Geometry, contiguity, Moran's I and map tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarea.functions import GDA94_AUSTRALIA_LAMBERT, ratio
from tessarea.operators import autocorrelation as ac
from tessarea.operators import graph as g
from tessarea.operators import maplayer as ml
from tessarea.operators.frame import append_rows, row_slice
from tessarea.operators.model import residual_table, sir, sir_with_fallback
from tessarea.plans.levels import sir_map
from tessarea.session import cut_lineage, scratch_path
from tessarea.sources import attributes, read_layer, write_layer

from . import models
from .oracle import LEVEL_KEYS
from .registry import query, r
from .tables import Tables

BOX = (10.0, 0.0, 20.0, 5.0)


@query(
    "geometry_vertices",
    f"""SELECT area AS MB_CODE16, 0 AS ring, CAST(pos AS INTEGER) AS pos, {r("x")} AS x, {r("y")} AS y FROM t_mesh_points""",
)
def geometry_vertices(t: Tables):
    return g.vertices(t.mesh_layer, "MB_CODE16")


@query(
    "layer_roundtrip",
    f"""SELECT area AS SA1_MAIN16, CAST(pos AS INTEGER) AS pos, {r("x")} AS x, {r("y")} AS y FROM t_sa1_points""",
)
def layer_roundtrip(t: Tables):
    """Written as GeoJSON features and read back."""
    path = scratch_path(t.spark, "layer")
    write_layer(t.sa1_layer, path)
    back = read_layer(t.spark, path, "SA1_MAIN16 bigint")
    return g.vertices(back, "SA1_MAIN16").select("SA1_MAIN16", "pos", "x", "y")


@query("attributes", "SELECT MB_CODE16, SA1_MAIN16, SA2_MAIN16, SA2_NAME16, SA3_CODE16, SA4_CODE16, STE_CODE16, STE_NAME16 FROM t_mesh")
def layer_attributes(t: Tables):
    return attributes(t.mesh_layer)


def _edges_sql(table: str) -> str:
    return f"SELECT src, dst FROM {table}"


@query("contiguity_rook", _edges_sql("t_mesh_edges"))
def contiguity_rook(t: Tables):
    return t.mesh_edges


@query("contiguity_queen", _edges_sql("t_mesh_queen"))
def contiguity_queen(t: Tables):
    return g.contiguity(t.mesh_layer, "MB_CODE16", queen=True)


@query("contiguity_sa1", _edges_sql("t_sa1_edges"))
def contiguity_sa1(t: Tables):
    return g.contiguity(t.sa1_layer, "SA1_MAIN16")


@query("contiguity_sa2", _edges_sql("t_sa2_edges"))
def contiguity_sa2(t: Tables):
    return g.contiguity(t.sa2_layer, "SA2_MAIN16")


@query(
    "contiguity_levels",
    "\nUNION ALL\n".join(
        f"SELECT '{level}' AS level, src, dst FROM t_{short}_edges"
        for short, level in (("mesh", "Mesh"), ("sa1", "SA1"), ("sa2", "SA2"), ("sa3", "SA3"), ("sa4", "SA4"))
    ),
)
def contiguity_levels(t: Tables):
    from tessarea.plans.levels import study_edges

    return study_edges(t.layers)


@query("weights", f"SELECT src, dst, {r('1')} AS w FROM t_mesh_edges")
def weights(t: Tables):
    return g.weights(t.mesh_edges)


@query(
    "degree",
    """SELECT SA2_MAIN16, count(src) AS n_neighbours
FROM (SELECT DISTINCT SA2_MAIN16 FROM t_mesh) a LEFT JOIN t_sa2_edges ON src = SA2_MAIN16 GROUP BY SA2_MAIN16""",
)
def degree(t: Tables):
    edges = g.contiguity(t.sa2_layer, "SA2_MAIN16")
    return g.degree(t.sa2_layer, edges, "SA2_MAIN16")


@query(
    "degree_mesh",
    """SELECT MB_CODE16, count(src) AS n_neighbours
FROM t_mesh LEFT JOIN t_mesh_edges ON src = MB_CODE16 GROUP BY MB_CODE16""",
)
def degree_mesh(t: Tables):
    return g.degree(t.mesh, t.mesh_edges, "MB_CODE16")


@query(
    "islands",
    """SELECT DISTINCT SA2_MAIN16 FROM t_mesh WHERE SA2_MAIN16 NOT IN (SELECT src FROM t_sa2_edges)""",
)
def islands(t: Tables):
    edges = g.contiguity(t.sa2_layer, "SA2_MAIN16")
    return g.islands(attributes(t.sa2_layer), edges, "SA2_MAIN16")


@query(
    "drop_islands",
    f"""SELECT SA2_MAIN16, {r("sa2_count")} AS sa2_count FROM t_sa2 WHERE SA2_MAIN16 IN (SELECT src FROM t_sa2_edges)""",
)
def drop_islands(t: Tables):
    edges = g.contiguity(t.sa2_layer, "SA2_MAIN16")
    return g.drop_islands(t.sa2.select("SA2_MAIN16", "sa2_count"), edges, "SA2_MAIN16")


def _lcc_sql() -> str:
    p = GDA94_AUSTRALIA_LAMBERT
    n, scale, radius_0 = p.constants()
    e = p.eccentricity
    s = f"({e!r} * sin(radians(lat)))"
    conformal = f"(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {s}) / (1 + {s}), {e / 2!r}))"
    radius = f"({scale!r} * pow({conformal}, {n!r}))"
    angle = f"(radians(lon - {p.central_meridian!r}) * {n!r})"
    return f"""
SELECT MB_CODE16, pos, round({radius} * sin({angle}), 3) AS easting, round({radius_0!r} - {radius} * cos({angle}), 3) AS northing
FROM (SELECT area AS MB_CODE16, CAST(pos AS INTEGER) AS pos, 138 + x * CAST(0.3 AS DOUBLE) AS lon,
             -10 - 19 * ((y % 1000) / CAST(1000 AS DOUBLE)) AS lat FROM t_mesh_points) v"""


@query("project_lcc", _lcc_sql())
def project_lcc(t: Tables):
    """The grid is laid over Queensland first; millimetres are compared."""
    points = g.vertices(t.mesh_layer, "MB_CODE16").select(
        "MB_CODE16",
        "pos",
        (138 + F.col("x") * 0.3).alias("lon"),
        (-10 - 19 * ((F.col("y") % 1000) / 1000.0)).alias("lat"),
    )
    projected = g.project_lcc(points, GDA94_AUSTRALIA_LAMBERT, "lon", "lat")
    return projected.select(
        "MB_CODE16", "pos", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing")
    )


@query(
    "with_geometry",
    f"""SELECT MB_CODE16, {r('"count"')} AS "count", {r("x")} AS x, {r("y")} AS y, CAST(pos AS INTEGER) AS pos
FROM t_mesh_counts JOIN t_mesh_points ON MB_CODE16 = area""",
)
def with_geometry(t: Tables):
    spatial = ml.with_geometry(t.counts("Mesh").select("MB_CODE16", "count"), t.mesh_layer, "MB_CODE16")
    points = g.vertices(spatial.select("MB_CODE16", "rings"), "MB_CODE16").drop("ring")
    return points.join(spatial.drop("rings"), "MB_CODE16")


def moran_sql(values: str, edges: str) -> str:
    """CTE ``m``: the parts of Moran's I of ``values(area, x)``."""
    return f"""
WITH v AS MATERIALIZED ({values}),
z AS MATERIALIZED (SELECT area, x - (SELECT avg(x) FROM v) AS z FROM v),
d AS (SELECT src, count(*) AS d FROM {edges} GROUP BY src),
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(d) AS DOUBLE) AS s0, 2.0 * sum(d) AS s1, 4.0 * sum(d * d) AS s2,
             (SELECT sum(z * z) FROM z) AS zz, (SELECT sum(z * z * z * z) FROM z) AS z4,
             (SELECT sum(a.z * b.z) FROM {edges} JOIN z a ON src = a.area JOIN z b ON dst = b.area) AS cross_sum
      FROM d)"""


MESH_X = 'SELECT MB_CODE16 AS area, "count" AS x FROM t_mesh_counts'
SA1_X = 'SELECT SA1_MAIN16 AS area, "count" AS x FROM t_sa1_counts'


def mesh_x(t: Tables) -> DataFrame:
    return t.counts("Mesh").select(F.col("MB_CODE16").alias("area"), F.col("count").alias("x"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Values and graph are read several times by a test, so they are written once."""
    return cut_lineage(df, label)


@query(
    "morans_i",
    moran_sql(MESH_X, "t_mesh_edges")
    + f" SELECT CAST(n AS BIGINT) AS n, {r('n * cross_sum / (s0 * zz)')} AS moran_i FROM m",
)
def morans_i(t: Tables):
    return ac.morans_i(stored(mesh_x(t), "x"), stored(t.mesh_edges, "edges"))


_TEST = """, w AS (SELECT *, n * cross_sum / (s0 * zz) AS i, -1.0 / (n - 1) AS e, n * z4 / (zz * zz) AS b2 FROM m),
y AS (SELECT *, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
               - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e AS var FROM w),
u AS (SELECT *, (i - e) / sqrt(var) AS z, 1 / (1 + 0.2316419 * abs((i - e) / sqrt(var))) AS t FROM y),
q AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937
             + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM u)"""


@query(
    "moran_test",
    moran_sql(MESH_X, "t_mesh_edges")
    + _TEST
    + f""" SELECT {r('i')} AS moran_i, {r('e')} AS expectation, {r('var')} AS variance, {r('z')} AS z,
       {r('CASE WHEN z >= 0 THEN tail ELSE 1 - tail END')} AS p_value FROM q""",
)
def moran_test(t: Tables):
    return ac.moran_test(stored(mesh_x(t), "x"), stored(t.mesh_edges, "edges"))


def moran_mc_sql(values: str, edges: str, nsim: int, seed: int) -> str:
    """The same bijection of the same numbers, a round at a time."""

    def mixed(half: str, k: int) -> str:
        t = f"(({half} * {ac.FACTORS[0]} + k{k}) % {ac.PRIME})"
        t = f"((xor({t}, {t} >> 15) * {ac.FACTORS[1]}) % {ac.PRIME})"
        return f"((xor({t}, {t} >> 13) * {ac.FACTORS[2]}) % {ac.PRIME})"

    def walked(source: str, where: str) -> str:
        """One pass of the rounds over ``x``."""
        sql = f"SELECT * EXCLUDE (x), x // b AS l, x % b AS r FROM {source} WHERE {where}"
        for k in range(ac.ROUNDS):
            side, other, size = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
            sql = f"SELECT * REPLACE (({side} + {mixed(other, k)}) % {size} AS {side}) FROM ({sql}) w{k}"
        return f"SELECT * EXCLUDE (l, r), l * b + r AS x FROM ({sql}) w"

    keys = ", ".join(
        f"CAST('0x' || substr(md5('{seed}|' || CAST(range AS VARCHAR) || '|{k}'), 1, {ac.ROUND_DIGITS}) AS BIGINT) AS k{k}"
        for k in range(ac.ROUNDS)
    )
    return f"""SELECT * FROM (WITH RECURSIVE {moran_sql(values, edges).strip()[5:]},
nu AS MATERIALIZED (SELECT area, z, row_number() OVER (ORDER BY substr(md5('{seed}|' || CAST(area AS VARCHAR)), 1, {ac.KEY_DIGITS}), area) - 1 AS num FROM z),
sz AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM nu),
gr AS MATERIALIZED (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, unnest(range(greatest(2, (root + 1) // 2), greatest(2, root) + 1)) AS a FROM sz) g
      ORDER BY a * ((n + a - 1) // a) - n, a DESC LIMIT 1),
ks AS MATERIALIZED (SELECT range AS sim, {keys} FROM range(1, {nsim + 1})),
x0 AS (SELECT ks.*, num, n, a, b, num AS x FROM nu CROSS JOIN ks CROSS JOIN gr),
wk AS ({walked("x0", "true")} UNION ALL ({walked("wk", "x >= n")})),
p AS MATERIALIZED (SELECT sim, o.area, b.z FROM wk JOIN nu b ON x = b.num JOIN nu o ON wk.num = o.num),
c AS (SELECT p.sim, sum(p.z * q.z) AS s FROM {edges} JOIN p ON src = p.area JOIN p q ON dst = q.area AND p.sim = q.sim
      GROUP BY p.sim)
SELECT {r('max(n * cross_sum / (s0 * zz))')} AS moran_i, {nsim} AS nsim,
       count(*) FILTER (WHERE s >= cross_sum - 1e-10 * zz) AS n_at_least,
       {r(f'(count(*) FILTER (WHERE s >= cross_sum - 1e-10 * zz) + 1) / CAST({nsim + 1} AS DOUBLE)')} AS p_value
FROM c CROSS JOIN m) mc"""


@query("moran_mc", moran_mc_sql(SA1_X, "t_sa1_edges", 999, 1))
def moran_mc(t: Tables):
    values = t.counts("SA1").select(F.col("SA1_MAIN16").alias("area"), F.col("count").alias("x"))
    edges = g.contiguity(t.sa1_layer, "SA1_MAIN16")
    return ac.moran_mc(stored(values, "x"), stored(edges, "edges"), 999, 1)


@query("moran_mc_mesh", moran_mc_sql(MESH_X, "t_mesh_edges", 999, 7))
def moran_mc_mesh(t: Tables):
    return ac.moran_mc(stored(mesh_x(t), "x"), stored(t.mesh_edges, "edges"), 999, 7)


RESIDUAL_X = "SELECT MB_CODE16 AS area, (observed - fitted) / sqrt(fitted) AS x FROM t_fit"
# Only edges between fitted areas.
_FITTED_EDGES = """(SELECT src, dst FROM t_mesh_edges WHERE src IN (SELECT MB_CODE16 FROM t_fit)
  AND dst IN (SELECT MB_CODE16 FROM t_fit)) fe"""


RESIDUAL_NSIM = 10_000


@query("residual_moran", moran_mc_sql(RESIDUAL_X, _FITTED_EDGES, RESIDUAL_NSIM, 3))
def residual_moran(t: Tables):
    residuals = residual_table(t.fit).select(F.col("MB_CODE16").alias("area"), F.col("residual").alias("x"))
    return ac.moran_mc(residuals, stored(t.mesh_edges, "edges"), RESIDUAL_NSIM, 3)


def residual_moran_all_sql(nsim: int = RESIDUAL_NSIM, tol: float = models.TOL) -> str:
    """The test of every smoothed fit; a saturated fit has no residuals and no result."""
    residuals = models.bym_sql(
        models._ALL,
        models._ALL_EDGES,
        "SELECT level, variant, area, round((o - mu) / sqrt(mu), 9) AS x FROM fitted",
        tol=tol,
    )
    parts = []
    for level, variant, *_ in models.MEDIAN_VARIANCES:
        of = f"level = '{level}' AND variant = '{variant}'"
        test = moran_mc_sql(
            f"SELECT area, x FROM residuals WHERE {of}", f"(SELECT src, dst FROM t_edges WHERE {of}) fe", nsim, 1
        )
        known = "moran_i IS NOT NULL AND NOT isnan(moran_i)"
        parts.append(
            f"""SELECT '{level}' AS level, '{variant}' AS variant, moran_i, nsim, CASE WHEN {known} THEN n_at_least END AS n_at_least,
  CASE WHEN {known} THEN p_value END AS p_value FROM ({test}) {level.lower()}_{variant}"""
        )
    return f"SELECT * FROM (WITH residuals AS MATERIALIZED ({residuals}) {' UNION ALL '.join(parts)}) tests"


@query("residual_moran_all", residual_moran_all_sql())
def residual_moran_all(t: Tables):
    """The ten fits of the study: five levels, without and with covariate."""
    return models.settled_study(t).residual_moran_all(RESIDUAL_NSIM)


# Areas without a value are left out of the graph, with their edges.
PART_X = 'SELECT MB_CODE16 AS area, "count" AS x FROM t_mesh_counts JOIN t_scored USING (MB_CODE16)'
_PART_EDGES = """(SELECT src, dst FROM t_mesh_edges WHERE src IN (SELECT MB_CODE16 FROM t_mesh_counts JOIN t_scored USING (MB_CODE16))
  AND dst IN (SELECT MB_CODE16 FROM t_mesh_counts JOIN t_scored USING (MB_CODE16))) pe"""
_TEST_ROW = f"""{r('i')} AS moran_i, {r('e')} AS expectation, {r('var')} AS variance, {r('z')} AS z,
       {r('CASE WHEN z >= 0 THEN tail ELSE 1 - tail END')} AS p_value FROM q"""


@query("moran_test_part", f"{moran_sql(PART_X, _PART_EDGES)}{_TEST} SELECT {_TEST_ROW}")
def moran_test_part(t: Tables):
    """Values of some areas only, with the graph of all."""
    values = mesh_x(t).join(t.scored_blocks.withColumnRenamed("MB_CODE16", "area"), "area", "left_semi")
    return ac.moran_test(stored(values, "x"), stored(t.mesh_edges, "edges"))


COUNT_LEVELS = (("SA1", "sa1", "SA1_MAIN16"), ("SA2", "sa2", "SA2_MAIN16"), ("SA3", "sa3", "SA3_CODE16"))


def _levels(sql) -> str:
    """The same test of the counts at each level, one row per level."""
    parts = []
    for level, short, key in COUNT_LEVELS:
        values = f'SELECT {key} AS area, "count" AS x FROM t_{short}_counts'
        parts.append(f"SELECT '{level}' AS level, * FROM ({sql(values, f't_{short}_edges')}) {short}_x")
    return " UNION ALL ".join(parts)


def level_values(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Counts and graphs of the three levels under one key."""
    values, shapes = [], []
    for level, _, key in COUNT_LEVELS:
        names = (F.lit(level).alias("level"), F.col(key).cast("bigint").alias("area"))
        values.append(t.counts(level).select(*names, F.col("count").alias("x")))
        shapes.append(t.layers[level].select(*names, "rings"))
    graph = g.contiguity(reduce(DataFrame.unionByName, shapes), "area", by=["level"])
    return stored(reduce(DataFrame.unionByName, values), "x"), stored(graph, "edges")


@query("moran_test_levels", _levels(lambda v, e: f"{moran_sql(v, e)}{_TEST} SELECT {_TEST_ROW}"))
def moran_test_levels(t: Tables):
    return ac.moran_test(*level_values(t), by=["level"])


@query("moran_mc_levels", _levels(lambda v, e: moran_mc_sql(v, e, 999, 1)))
def moran_mc_levels(t: Tables):
    return ac.moran_mc(*level_values(t), 999, 1, by=["level"])


def raw_sir(t: Tables) -> DataFrame:
    return sir(t.counts("Mesh"), "count", "expect")


_RAW = 'SELECT MB_CODE16, "count" / nullif(expect, 0) AS sir FROM t_mesh_counts'
_ENVELOPE = """SELECT area, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM t_mesh_points GROUP BY area"""
_IN_BOX = f"xmax >= {BOX[0]} AND xmin <= {BOX[2]} AND ymax >= {BOX[1]} AND ymin <= {BOX[3]}"


@query("sir_mesh", f"SELECT MB_CODE16, {r('sir')} AS sir FROM ({_RAW}) s")
def sir_mesh(t: Tables):
    return raw_sir(t).select("MB_CODE16", "sir")


@query(
    "map_layer",
    f"""SELECT MB_CODE16, {r("CASE WHEN sir BETWEEN 0 AND 1.6 THEN sir END")} AS sir, {r("xmin")} AS xmin, {r("ymin")} AS ymin,
       {r("xmax")} AS xmax, {r("ymax")} AS ymax
FROM ({_RAW}) s JOIN ({_ENVELOPE}) e ON MB_CODE16 = area WHERE {_IN_BOX}""",
)
def map_layer(t: Tables):
    table = ml.map_layer(raw_sir(t), t.mesh_layer, "MB_CODE16", "sir", (0.0, 1.6), BOX)
    xmin, ymin, xmax, ymax = g.envelope()
    return table.select(
        "MB_CODE16", "sir", xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax")
    )


MAP_LIMITS = (1.6, 2.0)


def _map_layers_sql() -> str:
    """Raw ratios of every level, censored to either scale, with the envelopes of the areas."""
    parts = []
    for short, (level, key) in LEVEL_KEYS.items():
        ratios = f'SELECT CAST({key} AS BIGINT) AS area, "count" / nullif(expect, 0) AS sir FROM t_{short}_counts'
        box = f"SELECT CAST(area AS BIGINT) AS area, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM t_{short}_points GROUP BY area"
        for limit in MAP_LIMITS:
            parts.append(
                f"""SELECT '{level}' AS level, CAST({limit} AS DOUBLE) AS upper, area,
  {r(f"CASE WHEN sir BETWEEN 0 AND {limit} THEN sir END")} AS sir, {r("xmin")} AS xmin, {r("ymin")} AS ymin,
  {r("xmax")} AS xmax, {r("ymax")} AS ymax FROM ({ratios}) s JOIN ({box}) b USING (area)"""
            )
    return " UNION ALL ".join(parts)


@query("map_layers", _map_layers_sql())
def map_layers(t: Tables):
    """The map tables of all levels and both scales as one table."""
    corners = [c.alias(n) for c, n in zip(g.envelope(), ("xmin", "ymin", "xmax", "ymax"))]
    parts = []
    for level, key in LEVEL_KEYS.values():
        for limit in MAP_LIMITS:
            shown = sir_map(t, level, t.sa2, limits=(0.0, limit))
            names = (F.lit(level).alias("level"), F.lit(limit).alias("upper"), F.col(key).cast("bigint").alias("area"))
            parts.append(shown.select(*names, "sir", *corners))
    return reduce(DataFrame.unionByName, parts)


@query("bbox_filter", f"SELECT area AS MB_CODE16 FROM ({_ENVELOPE}) e WHERE {_IN_BOX}")
def bbox_filter(t: Tables):
    return ml.bbox_filter(t.mesh_layer, *BOX).select("MB_CODE16")


# Windows over the grid of the mesh layer, which is fifty units wide.
WINDOWS = {"west": (0.0, 0.0, 4.0, 3.0), "middle": BOX, "point": (7.0, 2.0, 7.0, 2.0), "outside": (900.0, 900.0, 901.0, 901.0)}


def _windows_sql() -> str:
    parts = []
    for name, (x0, y0, x1, y1) in WINDOWS.items():
        inside = f"xmax >= {x0} AND xmin <= {x1} AND ymax >= {y0} AND ymin <= {y1}"
        parts.append(f"SELECT '{name}' AS box, area AS MB_CODE16, {r('xmin')} AS xmin, {r('ymin')} AS ymin FROM ({_ENVELOPE}) e WHERE {inside}")
    return " UNION ALL ".join(parts)


@query("bbox_windows", _windows_sql())
def bbox_windows(t: Tables):
    """Windows of the stored layer, whose row groups follow a space-filling curve."""
    path = f"{scratch_path(t.spark, 'layer')}.parquet"
    write_layer(t.mesh_layer, path, by_place=True)
    layer = read_layer(t.spark, path)
    parts = [
        ml.bbox_filter(layer, *box).select(F.lit(name).alias("box"), "MB_CODE16", "bbox.xmin", "bbox.ymin")
        for name, box in WINDOWS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "censor_scale",
    f"""SELECT MB_CODE16, {r('CASE WHEN "count" BETWEEN 0 AND 2 THEN "count" END')} AS "count" FROM t_mesh_counts""",
)
def censor_scale(t: Tables):
    return ml.censor(t.counts("Mesh"), "count", 0.0, 2.0).select("MB_CODE16", "count")


@query(
    "row_slice",
    """SELECT MB_CODE16, SA1_MAIN16 FROM (SELECT *, row_number() OVER (ORDER BY MB_CODE16) AS k FROM t_mesh) x
WHERE k BETWEEN 20 AND 191""",
)
def rows_by_position(t: Tables):
    return row_slice(t.mesh.select("MB_CODE16", "SA1_MAIN16"), "MB_CODE16", 20, 191)


_FITTED = "SELECT MB_CODE16, fitted / nullif(expected, 0) AS sir FROM t_part"


def fit_sir(t: Tables) -> DataFrame:
    return t.partial_fit.select("MB_CODE16", ratio(F.col("fitted"), F.col("expected")).alias("sir"))


@query(
    "left_merge",
    f"""SELECT a.MB_CODE16, {r("a.sir")} AS sir_raw, {r("b.sir")} AS sir_fit
FROM ({_RAW}) a LEFT JOIN ({_FITTED}) b ON a.MB_CODE16 = b.MB_CODE16""",
)
def left_merge(t: Tables):
    raw = raw_sir(t).select("MB_CODE16", "sir")
    return ml.left_merge(raw, fit_sir(t), "MB_CODE16", ("_raw", "_fit"))


@query(
    "join_suffixed",
    f"""SELECT a.MB_CODE16, {r("a.sir")} AS sir_raw, {r("b.sir")} AS sir_fit
FROM ({_RAW}) a JOIN ({_FITTED}) b ON a.MB_CODE16 = b.MB_CODE16""",
)
def join_suffixed(t: Tables):
    return ml.join_suffixed(
        raw_sir(t).select("MB_CODE16", "sir"), fit_sir(t), ["MB_CODE16"], ("_raw", "_fit")
    )


@query(
    "align_by_key",
    f"""SELECT MB_CODE16, {r("coalesce(fitted, 0)")} AS fitted
FROM t_mesh LEFT JOIN (SELECT MB_CODE16, fitted FROM t_part) f USING (MB_CODE16)""",
)
def align_by_key(t: Tables):
    return ml.align_by_key(t.mesh.select("MB_CODE16"), t.partial_fit, "MB_CODE16", "fitted")


@query(
    "key_audit",
    """SELECT count(*) FILTER (WHERE b IS NULL) AS n_left_only, count(*) FILTER (WHERE a IS NULL) AS n_right_only,
       count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_both
FROM (SELECT MB_CODE16 AS a FROM t_mesh WHERE STE_CODE16 = '3') x FULL JOIN (SELECT MB_CODE16 AS b FROM t_part) y ON a = b""",
)
def key_audit(t: Tables):
    return ml.key_audit(t.mesh.where("STE_CODE16 = '3'"), t.partial_fit, "MB_CODE16")


AUDIT_BUCKETS = 256


def digests(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> list[DataFrame]:
    """Digests as they would be stored with each release."""
    return [stored(ml.release_digest(df, key, columns, AUDIT_BUCKETS), "digest") for df in (a, b)]


@query("release_audit", """SELECT count(*) FILTER (WHERE b IS NULL) AS n_left_only, count(*) FILTER (WHERE a IS NULL) AS n_right_only,
       count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_both
FROM (SELECT MB_CODE16 AS a FROM t_mesh WHERE STE_CODE16 = '3') x FULL JOIN (SELECT MB_CODE16 AS b FROM t_part) y ON a = b""")
def release_audit(t: Tables):
    """The audit of ``key_audit``, by digests of key buckets."""
    one, other = t.mesh.where("STE_CODE16 = '3'"), stored(t.partial_fit, "release")
    return ml.release_audit(one, other, *digests(one, other, "MB_CODE16", []), "MB_CODE16", AUDIT_BUCKETS)


@query(
    "release_changes",
    """SELECT MB_CODE16, CASE WHEN SA2_MAIN16 = 3 THEN 'removed' WHEN SA2_MAIN16 = 7 THEN 'changed' END AS change
FROM t_mesh WHERE SA2_MAIN16 IN (3, 7)
UNION ALL SELECT -MB_CODE16, 'added' FROM t_mesh WHERE SA2_MAIN16 = 11""",
)
def release_changes(t: Tables):
    """A release without one area, with another area renamed, and with new codes."""
    columns = ["SA1_MAIN16", "SA2_MAIN16", "SA2_NAME16"]
    old = t.mesh.select("MB_CODE16", *columns)
    renamed = F.when(F.col("SA2_MAIN16") == 7, F.concat("SA2_NAME16", F.lit(" (new)"))).otherwise(F.col("SA2_NAME16"))
    added = old.where("SA2_MAIN16 = 11").withColumn("MB_CODE16", -F.col("MB_CODE16"))
    new = old.where("SA2_MAIN16 <> 3").withColumn("SA2_NAME16", renamed).unionByName(added)
    return ml.release_changes(old, new, *digests(old, new, "MB_CODE16", columns), "MB_CODE16", columns, AUDIT_BUCKETS)


@query(
    "append_rows",
    f"""SELECT MB_CODE16, {r("fitted")} AS fitted FROM t_part
UNION ALL SELECT MB_CODE16, {r("0")} FROM t_mesh WHERE MB_CODE16 NOT IN (SELECT MB_CODE16 FROM t_part)""",
)
def appended(t: Tables):
    fit = t.partial_fit.select("MB_CODE16", "fitted")
    unfitted = t.mesh.select("MB_CODE16").join(fit, "MB_CODE16", "left_anti")
    return append_rows(fit, unfitted, fill={"fitted": 0.0})


@query(
    "sir_with_fallback",
    f"""SELECT a.MB_CODE16, {r("coalesce(b.sir, a.sir)")} AS sir_shown
FROM ({_RAW}) a LEFT JOIN ({_FITTED}) b ON a.MB_CODE16 = b.MB_CODE16""",
)
def with_fallback(t: Tables):
    shown = sir_with_fallback(
        raw_sir(t).select("MB_CODE16", "sir"),
        fit_sir(t).withColumnRenamed("sir", "fitted_sir"),
        "MB_CODE16", "sir", "fitted_sir", "sir_shown",
    )
    return shown.select("MB_CODE16", "sir_shown")
