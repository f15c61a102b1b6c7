"""SQL twins of the input tables, as named common table expressions.

A query's SQL may use any name below; ``complete`` puts the needed definitions
in front of it.
"""

from __future__ import annotations

import re

ISLAND_SHIFT = 1000

CTES: dict[str, str] = {}

CTES["t_mesh"] = """
SELECT c_custkey AS MB_CODE16,
       CAST(n_nationkey AS BIGINT) * 10
         + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
                             WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS SA1_MAIN16,
       CAST(n_nationkey AS BIGINT) AS SA2_MAIN16,
       n_name AS SA2_NAME16,
       CAST(n_regionkey AS BIGINT) AS SA3_CODE16,
       CAST(n_regionkey % 2 AS BIGINT) AS SA4_CODE16,
       CASE WHEN n_nationkey < 20 THEN '3' ELSE '1' END AS STE_CODE16,
       CASE WHEN n_nationkey < 20 THEN 'Queensland' ELSE 'Other' END AS STE_NAME16
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

CTES["t_pop"] = """
SELECT c_custkey AS MB_CODE_2016, CAST(coalesce(n, 0) AS BIGINT) AS Person
FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey
) u ON c_custkey = o_custkey"""

CTES["t_area_scores"] = """
SELECT CAST(c_nationkey AS BIGINT) AS sa2,
       round_even(sum(CAST(round(c_acctbal * 100) AS BIGINT)) / (count(*) * CAST(100 AS DOUBLE)), 0) AS irsdscore
FROM customer GROUP BY c_nationkey"""

CTES["t_cases"] = """
SELECT CAST(n_nationkey AS BIGINT) AS sa2, n_name AS sa2_name, o_orderstatus AS sex,
       l_linenumber AS site10group,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS "count",
       count(*) * max(share) AS expect, max(irsdscore) AS irsdscore
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
     JOIN t_area_scores ON t_area_scores.sa2 = n_nationkey
     CROSS JOIN (SELECT CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS share
                 FROM lineitem) s
GROUP BY n_nationkey, n_name, o_orderstatus, l_linenumber"""

CTES["t_conc"] = """
SELECT a.n_name AS SA2_NAME_2011, CAST(b.n_nationkey AS BIGINT) AS SA2_MAINCODE_2016,
       b.n_name AS SA2_NAME_2016, a.RATIO
FROM (SELECT n_name, n_nationkey AS target,
             CAST(CASE WHEN n_nationkey % 5 = 0 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS RATIO FROM nation
      UNION ALL
      SELECT n_name, (n_nationkey + 1) % 25, CAST(0.25 AS DOUBLE) FROM nation WHERE n_nationkey % 5 = 0) a
JOIN nation b ON a.target = b.n_nationkey"""

CTES["t_sa2"] = """
SELECT SA2_MAINCODE_2016 AS SA2_MAIN16, SA2_NAME_2016 AS SA2_NAME16,
       sum(c * RATIO) AS sa2_count, sum(e * RATIO) AS sa2_expect
FROM (SELECT sa2_name, sum("count") AS c, sum(expect) AS e FROM t_cases GROUP BY sa2_name) x
JOIN t_conc ON sa2_name = SA2_NAME_2011
GROUP BY SA2_MAINCODE_2016, SA2_NAME_2016"""

CTES["t_people"] = """
SELECT t_mesh.*, Person AS mesh_population FROM t_mesh JOIN t_pop ON MB_CODE16 = MB_CODE_2016"""

CTES["t_mesh_shares"] = """
SELECT *, mesh_population / nullif(CAST(mesh_pop_sum AS DOUBLE), 0) AS mesh_proportion
FROM (SELECT *, CAST(sum(mesh_population) OVER (PARTITION BY SA2_MAIN16) AS BIGINT) AS mesh_pop_sum
      FROM t_people) x"""

CTES["t_mesh_counts"] = """
SELECT MB_CODE16, sa2_count * mesh_proportion AS "count", sa2_expect * mesh_proportion AS expect
FROM t_mesh_shares m JOIN t_sa2 c ON m.SA2_MAIN16 = c.SA2_MAIN16 AND m.SA2_NAME16 = c.SA2_NAME16
WHERE mesh_proportion IS NOT NULL"""

CTES["t_sa1_shares"] = """
SELECT SA1_MAIN16, SA2_MAIN16, SA3_CODE16, SA4_CODE16, sa1_pop, sa2_pop,
       sa1_pop / nullif(CAST(sa2_pop AS DOUBLE), 0) AS sa1_prop
FROM (SELECT DISTINCT SA1_MAIN16, SA2_MAIN16, SA3_CODE16, SA4_CODE16 FROM t_people) d
JOIN (SELECT SA1_MAIN16, CAST(sum(mesh_population) AS BIGINT) AS sa1_pop FROM t_people GROUP BY SA1_MAIN16) a
  USING (SA1_MAIN16)
JOIN (SELECT SA2_MAIN16, CAST(sum(mesh_population) AS BIGINT) AS sa2_pop FROM t_people GROUP BY SA2_MAIN16) b
  USING (SA2_MAIN16)"""

CTES["t_sa1_counts"] = """
SELECT SA1_MAIN16, sa2_count * sa1_prop AS "count", sa2_expect * sa1_prop AS expect
FROM t_sa1_shares JOIN t_sa2 USING (SA2_MAIN16) WHERE sa1_prop IS NOT NULL"""

for _level, _key in (("sa3", "SA3_CODE16"), ("sa4", "SA4_CODE16")):
    CTES[f"t_{_level}_counts"] = f"""
SELECT {_key}, sum(sa2_count) AS "count", sum(sa2_expect) AS expect
FROM (SELECT DISTINCT SA2_MAIN16, {_key} FROM t_mesh) d JOIN t_sa2 USING (SA2_MAIN16)
GROUP BY {_key}"""

CTES["t_scores"] = """
SELECT SA1_MAIN16,
       round_even(sum(CAST(round(c_acctbal * 100) AS BIGINT)) / (count(*) * CAST(100 AS DOUBLE)), 0) AS SA1_irsdscore,
       CAST(sum(mesh_population) AS BIGINT) AS SA1_pop
FROM t_people JOIN customer ON MB_CODE16 = c_custkey GROUP BY SA1_MAIN16"""


def weighted_sql(key: str, dedup: bool = False) -> str:
    """Weighted score per area of ``key``; with ``dedup`` every SA1 counts once."""
    rows = "1" if dedup else "n"
    return f"""
SELECT {key}, round_even(sum(SA1_irsdscore * (SA1_pop * {rows})) / nullif(CAST(sum(SA1_pop * {rows}) AS DOUBLE), 0), 0) AS score
FROM t_scores JOIN (SELECT u, {key}, count(*) AS n
                    FROM (SELECT SA1_MAIN16 AS u, {key} FROM t_mesh) m GROUP BY u, {key}) h
     ON t_scores.SA1_MAIN16 = h.u
GROUP BY {key}"""


CTES["t_sa3_scores"] = weighted_sql("SA3_CODE16")
CTES["t_sa4_scores"] = weighted_sql("SA4_CODE16")
CTES["t_sa1_scores"] = """
SELECT SA1_MAIN16, round_even(SA1_irsdscore * SA1_pop / nullif(CAST(SA1_pop AS DOUBLE), 0), 0) AS score
FROM t_scores"""
CTES["t_sa2_scores"] = """
SELECT DISTINCT SA2_MAINCODE_2016 AS SA2_MAIN16, irsdscore AS score
FROM t_conc JOIN (SELECT DISTINCT sa2_name, irsdscore FROM t_cases) c ON SA2_NAME_2016 = sa2_name"""
CTES["t_mesh_scores"] = """
SELECT MB_CODE16, SA1_irsdscore * mesh_population / nullif(CAST(SA1_pop AS DOUBLE), 0) AS score
FROM t_people JOIN t_scores USING (SA1_MAIN16)"""

LEVEL_KEYS = {
    "mesh": ("Mesh", "MB_CODE16"),
    "sa1": ("SA1", "SA1_MAIN16"),
    "sa2": ("SA2", "SA2_MAIN16"),
    "sa3": ("SA3", "SA3_CODE16"),
    "sa4": ("SA4", "SA4_CODE16"),
}
CTES["t_sa2_counts"] = 'SELECT SA2_MAIN16, sa2_count AS "count", sa2_expect AS expect FROM t_sa2'


def classes_sql(table: str, value: str, columns: str, out: str = "quintile") -> str:
    """Quintile class of ``value`` over the rows of ``table`` that have one."""
    return f"""
SELECT {columns}, CASE WHEN {value} <= q[1] THEN 1 WHEN {value} <= q[2] THEN 2 WHEN {value} <= q[3] THEN 3
                       WHEN {value} <= q[4] THEN 4 ELSE 5 END AS {out}
FROM (SELECT * FROM {table} WHERE {value} IS NOT NULL) v
CROSS JOIN (SELECT quantile_cont({value}, [0.2, 0.4, 0.6, 0.8]) AS q FROM {table} WHERE {value} IS NOT NULL) c"""


for _short, (_level, _key) in LEVEL_KEYS.items():
    CTES[f"t_{_short}_classes"] = classes_sql(f"t_{_short}_scores", "score", f"{_key}, score")


def frame_sql(short: str, with_classes: bool, round_expected: bool = False) -> str:
    _, key = LEVEL_KEYS[short]
    e = "round_even(expect, 0)" if round_expected else "expect"
    return f"""
SELECT {key}, round_even("count", 0) AS observed,
       CASE WHEN {e} = 0 THEN CAST(0.001 AS DOUBLE) ELSE {e} END AS expected,
       {"quintile" if with_classes else "CAST(NULL AS INTEGER) AS quintile"}
FROM t_{short}_counts {f"JOIN t_{short}_classes USING ({key})" if with_classes else ""}"""


CTES["t_mesh_frame"] = frame_sql("mesh", True)
CTES["t_frames"] = "\nUNION ALL\n".join(
    f"SELECT '{level}' AS level, '{variant}' AS variant, CAST({key} AS BIGINT) AS area, observed, expected, quintile "
    f"FROM ({frame_sql(short, variant == 'wc', (short, variant) in (('mesh', 'nc'), ('sa4', 'wc')))}) f"
    for short, (level, key) in LEVEL_KEYS.items()
    for variant in ("nc", "wc")
)

CTES["t_corners"] = """
SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) v(pos, dx, dy)"""
CTES["t_mesh_points"] = """
SELECT MB_CODE16 AS area, pos, CAST(MB_CODE16 % 50 + dx AS DOUBLE) AS x, CAST(MB_CODE16 // 50 + dy AS DOUBLE) AS y
FROM t_mesh CROSS JOIN t_corners"""
CTES["t_sa1_points"] = """
SELECT DISTINCT SA1_MAIN16 AS area, pos, CAST((SA1_MAIN16 // 10 % 5) * 5 + SA1_MAIN16 % 10 + dx AS DOUBLE) AS x,
       CAST((SA1_MAIN16 // 10 // 5) * 5 + 5 * dy AS DOUBLE) AS y
FROM t_mesh CROSS JOIN t_corners"""
CTES["t_sa2_points"] = f"""
SELECT DISTINCT SA2_MAIN16 AS area, pos,
       CAST((SA2_MAIN16 % 5) * 5 + 5 * dx + CASE WHEN SA2_MAIN16 = 24 THEN {ISLAND_SHIFT} ELSE 0 END AS DOUBLE) AS x,
       CAST((SA2_MAIN16 // 5) * 5 + 5 * dy AS DOUBLE) AS y
FROM t_mesh CROSS JOIN t_corners"""
CTES["t_sa3_points"] = """
SELECT DISTINCT SA3_CODE16 AS area, pos, CAST(SA3_CODE16 * 5 + 5 * dx AS DOUBLE) AS x, CAST(25 * dy AS DOUBLE) AS y
FROM t_mesh CROSS JOIN t_corners"""
CTES["t_sa4_points"] = """
SELECT DISTINCT SA4_CODE16 AS area, pos, CAST(SA3_CODE16 * 5 + 5 * dx AS DOUBLE) AS x, CAST(25 * dy AS DOUBLE) AS y
FROM t_mesh CROSS JOIN t_corners"""


def edges_sql(points: str, shared: int) -> str:
    return f"""
SELECT a.area AS src, b.area AS dst
FROM (SELECT DISTINCT area, x, y FROM {points}) a JOIN (SELECT DISTINCT area, x, y FROM {points}) b
  ON a.x = b.x AND a.y = b.y AND a.area <> b.area
GROUP BY a.area, b.area HAVING count(*) >= {shared}"""


for _short in LEVEL_KEYS:
    CTES[f"t_{_short}_edges"] = edges_sql(f"t_{_short}_points", 2)
    CTES[f"t_{_short}_queen"] = edges_sql(f"t_{_short}_points", 1)
# The graph of each fit holds only areas with a frame row at both ends.
CTES["t_edges"] = "SELECT level, variant, src, dst FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{level}' AS level, * FROM t_{short}_edges" for short, (level, _) in LEVEL_KEYS.items()
) + """) e JOIN (SELECT level AS lv, variant, area FROM t_frames) f ON lv = level AND area = src
WHERE EXISTS (SELECT 1 FROM t_frames g WHERE g.level = e.level AND g.variant = f.variant AND g.area = e.dst)"""

CTES["t_scored"] = "SELECT c_custkey AS MB_CODE16 FROM customer WHERE c_acctbal >= 0"


def rate_fit_sql(frame: str) -> str:
    return f"""
SELECT MB_CODE16, observed, expected, quintile, expected * so / se AS fitted
FROM ({frame}) f JOIN (SELECT quintile AS k, sum(observed) AS so, sum(expected) AS se
      FROM ({frame}) g GROUP BY quintile) s ON quintile = k"""


CTES["t_fit"] = rate_fit_sql("SELECT * FROM t_mesh_frame")
CTES["t_part"] = rate_fit_sql("SELECT t_mesh_frame.* FROM t_mesh_frame JOIN t_scored USING (MB_CODE16)")
CTES["t_draws"] = """
SELECT event_type AS level, 'nc' AS variant, 'beta' AS param, 1 AS idx, event_id AS iter, value FROM events"""
CTES["t_draw_fits"] = """
SELECT MB_CODE16, iter, expected * exp(0.01 * ((iter * 7 + MB_CODE16 * 3) % 11 - 5)) AS fitted
FROM t_mesh_frame CROSS JOIN (SELECT CAST(range AS INTEGER) AS iter FROM range(1, 51)) i"""


def complete(sql: str) -> str:
    """The query with all definitions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bt_[a-z0-9_]+\b", text):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql.strip()
    body = sql.strip()
    head = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name].strip()})" for name in ordered)
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
