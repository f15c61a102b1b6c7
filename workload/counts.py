"""Counts, populations, shares and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarea.functions import code_text, is_present, log_positive, ratio
from tessarea.operators import concordance as cc
from tessarea.operators import deprivation as dep
from tessarea.operators import frame as fr
from tessarea.operators import hierarchy as hi
from tessarea.operators import summary as su
from tessarea.operators.model import sir
from tessarea.plans import levels as lv
from tessarea.session import cut_lineage

from .oracle import LEVEL_KEYS, weighted_sql
from .registry import query, r
from .tables import Tables

SUMS = {"count": "sa2_count", "expect": "sa2_expect"}


@query(
    "sir_by_area",
    f"""
SELECT SA2_MAIN16, SA2_NAME16, {r("observed")} AS observed, {r("expected")} AS expected,
       {r("observed / expected")} AS sir
FROM (SELECT SA2_MAIN16, SA2_NAME16, round_even(sa2_count, 0) AS observed,
             CASE WHEN sa2_expect = 0 THEN CAST(0.001 AS DOUBLE) ELSE sa2_expect END AS expected FROM t_sa2) x""",
)
def sir_by_area(t: Tables):
    framed = fr.model_frame(lv.sa2_cases(t), "SA2_MAIN16", "sa2_count", "sa2_expect", keep=["SA2_NAME16"])
    return sir(framed, "observed", "expected")


@query(
    "collapse_strata",
    f"""SELECT sa2_name, {r('sum("count")')} AS sa2_count, {r("sum(expect)")} AS sa2_expect
FROM t_cases GROUP BY sa2_name""",
)
def collapse_strata(t: Tables):
    return cc.collapse_strata(t.cases, ["sa2_name"], SUMS)


@query(
    "collapse_strata_scored",
    f"""SELECT sa2_name, {r("irsdscore")} AS irsdscore, {r('sum("count")')} AS sa2_count, {r("sum(expect)")} AS sa2_expect
FROM t_cases GROUP BY sa2_name, irsdscore""",
)
def collapse_strata_scored(t: Tables):
    return cc.collapse_strata(t.scored_cases, ["sa2_name", "irsdscore"], SUMS)


@query(
    "concordance",
    f"""SELECT SA2_MAIN16, SA2_NAME16, {r("sa2_count")} AS sa2_count, {r("sa2_expect")} AS sa2_expect FROM t_sa2""",
)
def concordance(t: Tables):
    return lv.sa2_cases(t)


@query(
    "normalise_codes",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 3 THEN c_custkey * 10000 ELSE c_custkey END AS code,
       c_custkey * 100000000 AS number, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS part,
       CAST(c_custkey AS VARCHAR) AS code_text FROM customer""",
)
def normalise_codes(t: Tables):
    """Codes as text with spaces, decimals, exponents or junk, and as numbers whole or not."""
    text = F.col("c_custkey").cast("string")
    raw = t.scan("customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_name"))
        .when(F.col("c_custkey") % 5 == 1, F.concat(F.lit(" "), text))
        .when(F.col("c_custkey") % 5 == 2, F.concat(text, F.lit(".0")))
        .when(F.col("c_custkey") % 5 == 3, F.concat(text, F.lit("e4")))
        .otherwise(text)
        .alias("code"),
        (F.col("c_custkey") * 1e8).alias("number"),
        (F.col("c_custkey") + F.col("c_custkey") % 2 * 0.5).alias("part"),
    )
    codes = fr.normalise_codes(raw, ["code", "number", "part"])
    return codes.withColumn("code_text", code_text(F.col("c_custkey")))


@query(
    "drop_missing",
    f"""SELECT MB_CODE_2016, Person, {r("c_acctbal / Person")} AS balance_per_person
FROM t_pop JOIN customer ON MB_CODE_2016 = c_custkey WHERE Person > 0 AND c_acctbal >= 0""",
)
def drop_missing(t: Tables):
    """Zero population gives NaN and a negative balance NULL: both are dropped."""
    balance = t.scan("customer").select(F.col("c_custkey").alias("MB_CODE_2016"), "c_acctbal")
    measure = F.when(
        F.col("c_acctbal") >= 0,
        F.when(F.col("Person") == 0, F.lit(float("nan"))).otherwise(
            ratio(F.col("c_acctbal"), F.col("Person"))
        ),
    )
    joined = t.population.join(balance, "MB_CODE_2016").withColumn("balance_per_person", measure)
    return fr.drop_missing(joined, ["balance_per_person"]).drop("c_acctbal")


@query(
    "replace_zero",
    f"""SELECT MB_CODE_2016, {r("CASE WHEN Person = 0 THEN 0.0001 ELSE Person END")} AS Person FROM t_pop""",
)
def replace_zero(t: Tables):
    people = t.population.withColumn("Person", F.col("Person").cast("double"))
    return fr.replace_zero(people, "Person", 0.0001)


@query(
    "log_offset",
    f"""SELECT MB_CODE16, {r("ln(expected)")} AS log_offset FROM t_mesh_frame""",
)
def log_offset(t: Tables):
    return t.mesh_frame.select("MB_CODE16", log_positive(F.col("expected")).alias("log_offset"))


@query(
    "state_filter",
    "SELECT MB_CODE16, SA2_MAIN16, STE_CODE16 FROM t_mesh WHERE STE_NAME16 = 'Queensland'",
)
def state_filter(t: Tables):
    return fr.keep_equal(t.mesh, "STE_NAME16", "Queensland").select(
        "MB_CODE16", "SA2_MAIN16", "STE_CODE16"
    )


@query(
    "site_filter",
    f"""SELECT sa2_name, {r('sum("count")')} AS sa2_count, {r("sum(expect)")} AS sa2_expect
FROM t_cases WHERE site10group = 1 GROUP BY sa2_name""",
)
def site_filter(t: Tables):
    return cc.collapse_strata(fr.keep_equal(t.cases, "site10group", 1), ["sa2_name"], SUMS)


@query(
    "attach_population",
    "SELECT MB_CODE16, SA1_MAIN16, SA2_MAIN16, SA3_CODE16, SA4_CODE16, mesh_population FROM t_people",
)
def attach_population(t: Tables):
    return lv.populated_mesh(t).select(
        "MB_CODE16", "SA1_MAIN16", "SA2_MAIN16", "SA3_CODE16", "SA4_CODE16", "mesh_population"
    )


@query(
    "population_totals",
    """SELECT 'SA1' AS level, SA1_MAIN16 AS area, CAST(sum(mesh_population) AS BIGINT) AS persons FROM t_people GROUP BY SA1_MAIN16
UNION ALL
SELECT 'SA2', SA2_MAIN16, CAST(sum(mesh_population) AS BIGINT) FROM t_people GROUP BY SA2_MAIN16""",
)
def population_totals(t: Tables):
    mesh = lv.populated_mesh(t)
    parts = [
        hi.population_by(mesh, key, "mesh_population", "persons").select(
            F.lit(level).alias("level"), F.col(key).alias("area"), "persons"
        )
        for level, key in (("SA1", "SA1_MAIN16"), ("SA2", "SA2_MAIN16"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "attach_total",
    """SELECT MB_CODE16, SA2_MAIN16, mesh_population, mesh_pop_sum FROM t_mesh_shares""",
)
def attach_total(t: Tables):
    mesh = lv.populated_mesh(t).select("MB_CODE16", "SA2_MAIN16", "mesh_population")
    return hi.attach_total(mesh, "SA2_MAIN16", "mesh_population", "mesh_pop_sum")


@query(
    "population_share",
    f"""SELECT SA1_MAIN16, SA2_MAIN16, SA3_CODE16, SA4_CODE16, sa1_pop, sa2_pop, {r("sa1_prop")} AS sa1_prop FROM t_sa1_shares""",
)
def population_share(t: Tables):
    return lv.sa1_shares(t)


@query(
    "mesh_share",
    f"""SELECT MB_CODE16, SA2_MAIN16, {r("mesh_proportion")} AS mesh_proportion FROM t_mesh_shares""",
)
def mesh_share(t: Tables):
    return lv.mesh_shares(t).select("MB_CODE16", "SA2_MAIN16", "mesh_proportion")


@query(
    "share_check",
    f"""SELECT SA2_MAIN16, {r("sum(mesh_proportion)")} AS share_sum,
       coalesce(abs(sum(mesh_proportion) - 1) <= 1e-9, FALSE) AS ok
FROM t_mesh_shares GROUP BY SA2_MAIN16""",
)
def share_check(t: Tables):
    return hi.share_check(lv.mesh_shares(t), "SA2_MAIN16", "mesh_proportion")


def _counts_sql(short: str, key: str) -> str:
    return f"""SELECT {key}, {r('"count"')} AS "count", {r("expect")} AS expect FROM t_{short}_counts"""


@query("apportion_mesh", _counts_sql("mesh", "MB_CODE16"))
def apportion_mesh(t: Tables):
    return t.counts("Mesh")


@query("apportion_sa1", _counts_sql("sa1", "SA1_MAIN16"))
def apportion_sa1(t: Tables):
    return t.counts("SA1")


@query("roll_up_sa3", _counts_sql("sa3", "SA3_CODE16"))
def roll_up_sa3(t: Tables):
    return t.counts("SA3")


@query("roll_up_sa4", _counts_sql("sa4", "SA4_CODE16"))
def roll_up_sa4(t: Tables):
    return t.counts("SA4")


@query(
    "crosswalk",
    "SELECT DISTINCT SA1_MAIN16, SA2_MAIN16, SA3_CODE16, SA4_CODE16 FROM t_mesh",
)
def crosswalk(t: Tables):
    return hi.crosswalk(t.mesh, ["SA1_MAIN16", "SA2_MAIN16", "SA3_CODE16", "SA4_CODE16"])


@query(
    "composite_key_join",
    f"""SELECT MB_CODE16, SA2_MAIN16, SA2_NAME16, {r("sa2_count")} AS sa2_count
FROM t_people JOIN t_sa2 USING (SA2_MAIN16, SA2_NAME16)""",
)
def composite_key_join(t: Tables):
    return (
        lv.populated_mesh(t)
        .join(t.sa2, ["SA2_MAIN16", "SA2_NAME16"])
        .select("MB_CODE16", "SA2_MAIN16", "SA2_NAME16", "sa2_count")
    )


@query(
    "duplicate_keys",
    "SELECT SA1_MAIN16, count(*) AS n_rows FROM t_mesh GROUP BY SA1_MAIN16 HAVING count(*) > 1",
)
def duplicate_keys(t: Tables):
    return hi.duplicate_keys(t.mesh, ["SA1_MAIN16"])


@query(
    "distinct_count",
    """SELECT count(*) AS n_distinct, count(*) FILTER (WHERE l IS NULL) AS n_missing
FROM (SELECT DISTINCT CASE WHEN c_acctbal >= 0 THEN c_name END AS l FROM customer) x""",
)
def distinct_count(t: Tables):
    named = t.scan("customer").select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name")
    )
    return hi.distinct_count(named, "name")


def _score_sql(body: str, key: str) -> str:
    return f"SELECT {key}, {r('score')} AS score FROM ({body}) s"


@query("weighted_score", _score_sql(weighted_sql("SA3_CODE16"), "SA3_CODE16"))
def weighted_score(t: Tables):
    return _weighted(t, "SA3_CODE16", "per_mesh_row")


@query("weighted_score_dedup", _score_sql(weighted_sql("SA3_CODE16", dedup=True), "SA3_CODE16"))
def weighted_score_dedup(t: Tables):
    return _weighted(t, "SA3_CODE16", "per_sa1")


@query("weighted_score_sa4", _score_sql(weighted_sql("SA4_CODE16"), "SA4_CODE16"))
def weighted_score_sa4(t: Tables):
    return _weighted(t, "SA4_CODE16", "per_mesh_row")


@query("weighted_score_sa1", _score_sql("SELECT * FROM t_sa1_scores", "SA1_MAIN16"))
def weighted_score_sa1(t: Tables):
    return _weighted(t, "SA1_MAIN16", "per_mesh_row")


def _weighted(t: Tables, key: str, weights: str):
    return dep.weighted_score(
        t.scores, t.mesh, "SA1_MAIN16", key, "SA1_irsdscore", "SA1_pop", "score", weights
    )


@query("mesh_score", _score_sql("SELECT * FROM t_mesh_scores", "MB_CODE16"))
def mesh_score(t: Tables):
    return dep.mesh_score(
        t.scores, lv.populated_mesh(t), "SA1_MAIN16", "SA1_irsdscore", "SA1_pop",
        "mesh_population", "score",
    ).select("MB_CODE16", "score")


@query("score_by_name", _score_sql("SELECT * FROM t_sa2_scores", "SA2_MAIN16"))
def score_by_name(t: Tables):
    return lv.level_scores(t, "SA2")


@query(
    "quantile_cuts",
    f"""SELECT p / CAST(5 AS DOUBLE) AS prob, {r("quantile_cont(score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])[p + 1]")} AS cut
FROM t_mesh_scores, (SELECT range AS p FROM range(0, 6)) x WHERE score IS NOT NULL GROUP BY p""",
)
def quantile_cuts(t: Tables):
    return dep.quantile_cuts(lv.level_scores(t, "Mesh"), "score")


@query("quintile", f"SELECT MB_CODE16, {r('score')} AS score, quintile FROM t_mesh_classes")
def quintile(t: Tables):
    return dep.quintile(lv.level_scores(t, "Mesh"), "score", "quintile")


@query("quintile_sa1", f"SELECT SA1_MAIN16, {r('score')} AS score, quintile FROM t_sa1_classes")
def quintile_sa1(t: Tables):
    return dep.quintile(lv.level_scores(t, "SA1"), "score", "quintile")


@query(
    "describe_measure",
    f"""SELECT {r('min("count")')} AS minimum, {r('quantile_cont("count", 0.25)')} AS q1,
       {r('quantile_cont("count", 0.5)')} AS median, {r('avg("count")')} AS mean,
       {r('quantile_cont("count", 0.75)')} AS q3, {r('max("count")')} AS maximum,
       count(*) FILTER (WHERE "count" IS NULL) AS n_missing
FROM t_mesh_counts""",
)
def describe_measure(t: Tables):
    # Read three times: for the sketch, for the exact cuts and for the moments.
    return su.describe_measure(cut_lineage(t.counts("Mesh"), "counts"), "count")


@query("measure_sd", f"""SELECT {r('stddev_samp("count")')} AS sd FROM t_mesh_counts""")
def measure_sd(t: Tables):
    return su.measure_sd(t.counts("Mesh"), "count")


@query("measure_range", f"""SELECT {r('min("count")')} AS lo, {r('max("count")')} AS hi FROM t_mesh_counts""")
def measure_range(t: Tables):
    return su.measure_range(t.counts("Mesh"), "count")


@query(
    "factor_levels",
    """SELECT quintile, quintile = (SELECT min(quintile) FROM t_mesh_classes) AS is_reference
FROM (SELECT DISTINCT quintile FROM t_mesh_classes) q""",
)
def factor_levels(t: Tables):
    classes = dep.quintile(lv.level_scores(t, "Mesh"), "score", "quintile")
    return dep.factor_levels(classes, "quintile")


def _frame_sql(body: str, key: str) -> str:
    return f"SELECT {key}, {r('observed')} AS observed, {r('expected')} AS expected, quintile FROM ({body}) f"


@query("model_frame", _frame_sql("SELECT * FROM t_mesh_frame", "MB_CODE16"))
def model_frame(t: Tables):
    return t.mesh_frame


@query(
    "study_frames",
    f"""SELECT level, variant, area, {r("observed")} AS observed, {r("expected")} AS expected, quintile FROM t_frames""",
)
def study_frames(t: Tables):
    return lv.study_frames(t, t.sa2)


@query(
    "complete_scores",
    f"""SELECT MB_CODE16, {r("score")} AS score FROM t_mesh_scores JOIN t_scored USING (MB_CODE16) WHERE score IS NOT NULL""",
)
def complete_scores(t: Tables):
    scored = lv.level_scores(t, "Mesh").join(t.scored_blocks, "MB_CODE16", "left_semi")
    return scored.where(is_present(F.col("score")))


def _level_totals_sql() -> str:
    """One query per level, under each other."""
    members = """SELECT p.*, c."count", c.expect FROM t_people p JOIN t_mesh_counts c USING (MB_CODE16)"""
    parts = [
        f"""SELECT '{level}' AS level, CAST({key} AS BIGINT) AS area, CAST(sum(mesh_population) AS BIGINT) AS population,
  {r('sum("count")')} AS "count", {r("sum(expect)")} AS expect FROM members GROUP BY {key}"""
        for level, key in LEVEL_KEYS.values()
    ]
    return f"WITH members AS MATERIALIZED ({members}) " + " UNION ALL ".join(parts)


@query("level_totals", _level_totals_sql())
def level_totals(t: Tables):
    """Population, counts and expected counts of all five levels from one pass over the blocks."""
    names = {"sa2_count": "count", "sa2_expect": "expect"}
    split = hi.apportion_down(lv.mesh_shares(t), t.sa2, ["SA2_MAIN16", "SA2_NAME16"], "mesh_proportion", names)
    known = fr.drop_missing(split, ["count", "expect"]).withColumnRenamed("mesh_population", "population")
    return hi.level_totals(known, lv.AREA_KEYS, ["population", "count", "expect"])
