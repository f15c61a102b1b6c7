"""Queries of the numbered operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, clustering, exact_dedup, language, line_dedup, mixing, packing, pieces, prefix_trie, simhash, suffix_dedup, token_output, toxicity
from .common import prepare, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MIX_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         'd' || ((strpos('0123456789abcdef', substr(md5(coalesce(source, '{mixing.NONE}')), 1, 1)) - 1) // 4) AS domain,
         coalesce(lang, '{mixing.NONE}') AS lang, coalesce(source, '{mixing.NONE}') AS source,
         CAST(len(regexp_split_to_array(regexp_replace(coalesce(text, ''),
              '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply FROM words GROUP BY ALL),
d0 AS (SELECT domain, sum(supply) * {mixing.EPOCHS} AS capacity,
              CASE WHEN domain = 'd0' THEN 2e0 ELSE 1e0 END AS weight FROM leaves GROUP BY domain),
d1 AS (SELECT *, (SELECT CAST(sum(supply) AS DOUBLE) * CAST({mixing.SHARE} AS DOUBLE) FROM leaves) AS given,
              coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
              sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wide FROM d0),
domains AS (SELECT domain, least(CAST(capacity AS DOUBLE), max((given - CAST(used AS DOUBLE)) / wide) OVER () * weight) AS budget FROM d1),
l0 AS (SELECT domain, lang, sum(supply) * {mixing.EPOCHS} AS capacity FROM leaves GROUP BY ALL),
l1 AS (SELECT l0.*, budget AS given,
              coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
              count(*) OVER (PARTITION BY domain ORDER BY capacity, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wide
       FROM l0 JOIN domains USING (domain)),
langs AS (SELECT domain, lang, least(CAST(capacity AS DOUBLE), max((given - CAST(used AS DOUBLE)) / wide) OVER (PARTITION BY domain)) AS budget FROM l1),
s0 AS (SELECT leaves.*, supply * {mixing.EPOCHS} AS capacity, budget AS given FROM leaves JOIN langs USING (domain, lang)),
s1 AS (SELECT *,
              coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
              count(*) OVER (PARTITION BY domain, lang ORDER BY capacity, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wide FROM s0),
plan AS (SELECT domain, lang, source, supply,
                CAST(floor(least(CAST(capacity AS DOUBLE), max((given - CAST(used AS DOUBLE)) / wide) OVER (PARTITION BY domain, lang)) + 0.5e0) AS BIGINT) AS budget FROM s1),
wanted AS (SELECT plan.*, e.epoch, least(supply, budget - e.epoch * supply) AS remaining
           FROM plan, (SELECT unnest(range({mixing.EPOCHS}))::INTEGER AS epoch) e),
ranked AS (SELECT words.*, epoch, remaining,
                  coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch
                    ORDER BY md5('{mixing.SEED}:' || epoch || ':' || doc_id)
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM words JOIN wanted USING (domain, lang, source) WHERE remaining > 0)
SELECT doc_id, epoch, domain, lang, source, tokens FROM ranked WHERE before < remaining
"""


@query("op6_source_mixing", MIX_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("tie")


EXACT_SQL = """
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t
"""


@query("op8_exact_dedup", EXACT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet").drop("file", "row")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


@query("op1_token_output")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "shards")
    token_output.write_shards(table(spark, sf_dir, "documents"), out)
    return token_output.read_slots(spark, out).withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


@query("op5_nearest_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


LINES_SQL = f"""
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
cut AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
common AS (SELECT trim(line) AS line FROM cut WHERE trim(line) <> '' GROUP BY 1
           HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
marked AS (SELECT cut.*, common.line IS NOT NULL AS gone FROM cut LEFT JOIN common ON trim(cut.line) = common.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""


@query("op7_line_dedup", LINES_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return found.withColumn("kept", F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


def _cluster_sql() -> str:
    """The rounds as one query each; vectors as lists of integers."""
    def nearest(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT rid, cluster, distance FROM (
    SELECT rid, n AS cluster, list_sum(list_transform(range(1, {clustering.DIMENSION + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS distance
    FROM kept CROSS JOIN c{k}) d QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)"""

    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {clustering.DIMENSION} AND len(list_filter(embedding, lambda x: isfinite(x))) = {clustering.DIMENSION})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || vec_id), v) - 1 AS n, v AS c FROM kept
    QUALIFY n < {clustering.CLUSTERS})""",
    ]
    for k in range(clustering.ROUNDS):
        parts.append(nearest(k))
        parts.append(
            f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.n, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (
    SELECT cluster, list((s - ((s % k) + k) % k) // k ORDER BY pos) AS c FROM (
      SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS k FROM (
        SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{k} JOIN kept USING (rid)) u GROUP BY cluster, pos) g
    GROUP BY cluster) m ON c{k}.n = m.cluster)"""
        )
    parts.append(nearest(clustering.ROUNDS))
    last = clustering.ROUNDS
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN kept USING (rid) JOIN c{last} ON cluster = n"""


@query("op11_centroid_clustering", _cluster_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.inertias(*clustering.cluster(table(spark, sf_dir, "embeddings")))


@query("op12_sentencepiece")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


# CRC-32 of the decimal id: its bytes, each followed by eight shifts (-1).
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

TRIE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {prefix_trie.GROUP} AS base, {_CRC} % {prefix_trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t) x),
hd AS (SELECT c.conv_id, t.pos AS d, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h),
nb AS (SELECT c.*, (SELECT count(*) FROM hd WHERE hd.conv_id = c.conv_id) AS nb FROM c),
r AS (SELECT * FROM hd UNION ALL SELECT conv_id, nb + pos - h AS d, role, text FROM t JOIN nb USING (conv_id) WHERE pos > h),
w AS MATERIALIZED (SELECT conv_id, d, length(text) AS chars,
    md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM w GROUP BY d, k),
pa AS MATERIALIZED (SELECT n.d, n.k, w.k AS pk, m.conv_id AS above FROM n JOIN w ON w.conv_id = n.conv_id AND w.d = n.d - 1 JOIN n m ON m.d = w.d AND m.k = w.k),
ch AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM pa GROUP BY d, pk),
v AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, above FROM n LEFT JOIN ch USING (d, k) LEFT JOIN pa USING (d, k)),
b AS (SELECT w.d, w.k, sum((n_convs - 1) * v.chars) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
      FROM v JOIN w ON w.conv_id = v.conv_id AND w.d <= v.d GROUP BY w.d, w.k),
e AS (SELECT d, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
      FROM w JOIN (SELECT conv_id, max(d) AS d FROM w GROUP BY conv_id) l USING (conv_id, d) GROUP BY d, k)
SELECT conv_id, CAST(d AS BIGINT) AS depth, above AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN b USING (d, k) LEFT JOIN e USING (d, k)"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))
