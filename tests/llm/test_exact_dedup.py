import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessarea.llm import exact_dedup

DOCS = "doc_id long, text string, digest string, file string, kept string"


def corpus():
    texts = ["a b", "a  b", "a\t\nb", " a b", "", None, " ", "c" * 100_000, "é  x", "é x", "\xa0", "A b"]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts * 3)]
    return rows + [(None, "a b", "", "", ""), (None, "only", "", "", ""), (5, "same", "", "", ""), (5, "same", "", "", "")]


def normal(text):
    return re.sub("[ \t-\r]+", " ", text or "")


def plain(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for body, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named) if named else None
        stays = 0
        for i in ids:
            first = i == keep and not stays
            stays += first
            out.append((i, keep, len(ids), first, hashlib.sha256(body.encode()).hexdigest()))
    return out


def key(r):
    return tuple((v is None, str(v)) for v in r)


@pytest.mark.parametrize("files", [1, 100])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda body: F.unhex(F.lpad(F.hex(F.crc32(body.cast("binary")) % 3), 2, "0"))])
def test_against_groups(spark, tmp_path, files, digest):
    """Also file by file, and with a digest under which unequal texts meet."""
    rows = corpus()
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(path)
    got = exact_dedup.dedup(spark, path, digest, files_per_batch=files).drop("file", "row")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame([(7, "a"), (8, "b")], "doc_id long, text string").write.parquet(path)
    assert exact_dedup.run_state(spark, path, checkpoint=state).count() == 2
    spark.createDataFrame([(3, "a"), (9, "c")], "doc_id long, text string").write.mode("append").parquet(path)
    found = exact_dedup.run_state(spark, path, checkpoint=state)
    assert sorted((r["first"].doc_id, r.n) for r in found.collect()) == [(3, 2), (8, 1), (9, 1)]


def test_keep_first(spark, rows):
    docs = spark.createDataFrame(corpus(), DOCS)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len({normal(r[1]) for r in corpus()})
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0


def test_single_file(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    (file,) = (tmp_path / "d").glob("part-*.parquet")
    got = exact_dedup.dedup(spark, str(file)).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False)]
