"""The pipeline and the registered queries against brute force, on the smallest tables."""

import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from tessarea.llm.queries import ORACLE, QUERIES
from tessarea.llm.tokens import tokenizer_path

from ..compare import connect, differences
from .test_exact_dedup import normal
from .test_mixing import plain_mix
from .test_simhash import plain_components, plain_fingerprint
from .test_suffix_dedup import plain as plain_repeats

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()
    return {r[0]: r for r in rows}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name]) is None


def test_every_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(QUERIES) <= set(entry_module.queries())


def test_stages_one_by_one(spark, docs, tmp_path):
    """Each stage takes all that its predecessor kept, and does what its operator says."""
    frame, before, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), dict(docs), {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, frame, SF_DIR).write.parquet(out)
        found = spark.read.parquet(out)
        if name != "packing":
            assert found.columns == frame.columns
        frame, kept[name] = found, found.collect()
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    toxic = {r.doc_id for r in QUERIES["op3_toxicity"](spark, SF_DIR).where("predicted = 1").collect()}
    assert sorted(ids["toxicity"]) == sorted(set(before) - toxic)
    first = {}
    for i in sorted(ids["toxicity"]):
        first.setdefault(normal(docs[i][1]), i)
    assert sorted(ids["exact_dedup"]) == sorted(first.values())
    prints = [(i, plain_fingerprint(docs[i][1])) for i in sorted(ids["exact_dedup"])]
    want = sorted(set(plain_components(prints)))
    assert sorted(ids["simhash_near_dedup"]) == want
    mixed = plain_mix([docs[i] for i in want], 0.6, 2, 13)
    assert sorted(ids["source_mixing"]) == sorted(r[0] for r in mixed)
    plain = Tokenizer.from_file(tokenizer_path())
    tokens, sequences, counted = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in kept["packing"]:
        whole = np.array(plain.encode(docs[r.doc_id][1] or "", add_special_tokens=False).ids + [1], "<u4")
        assert r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        tokens[r.doc_id] += r.length
        counted[r.doc_id] += r.start == 0
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length <= 2048
    assert all(tokens[i] == counted[i] * next(r.doc_tokens for r in kept["packing"] if r.doc_id == i) for i in tokens)
    assert sum(counted.values()) == len(mixed)
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()


def test_near_dedup_query(spark, docs):
    got = sorted(tuple(r)[:3] for r in QUERIES["op2_simhash_near_dedup"](spark, SF_DIR).collect())
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in docs.values()]
    assert got == sorted((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints)))


def test_repeats_query(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffix_dedup"](spark, SF_DIR).collect()}
    want = plain_repeats([(t or "").encode() for _, t, *_ in docs.values()])
    assert got == dict(zip(docs, want))


def test_nearest_neighbours_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_DIR}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x, ids = np.array([r[1] for r in rows], float), [r[0] for r in rows]
    got = defaultdict(list)
    for r in QUERIES["op5_nearest_neighbours"](spark, SF_DIR).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = []
    for k, q in enumerate(ids):
        if q % 20 == 0:
            s = x @ x[k]
            assert all(score == pytest.approx(s[ids.index(v)], rel=1e-12) for v, score in got[q])
            s[k] = -np.inf
            best = {ids[j] for j in np.argsort(-s, kind="stable")[:20]}
            hits.append(len(best & {v for v, _ in got[q]}) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("name, least", [("op1_token_output", 1), ("op4_language_id", 200), ("op8_exact_dedup", 200), ("op10_packing", 200)])
def test_whole_tables(spark, name, least):
    assert QUERIES[name](spark, SF_DIR).count() >= least
