import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessarea.llm import simhash
from tessarea.llm.components import components

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("mark", StringType())])


def plain_fingerprint(text):
    """The definition, one bit at a time."""
    words, lowered = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    word = ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (doc_id, fingerprint); every pair is compared."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 4:
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            groups[root(i)] = min(d, groups.get(root(i), d))
    return [groups.get(root(i)) for i in range(len(prints))]


def corpus():
    rnd = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "ß", "\xa0x"]
    rows = []
    for i in range(150):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 4, 5, 60, 300]))]
        rows.append((i, " ".join(words)))
        for _ in range(rnd.choice([0, 0, 2])):  # near copies
            near = list(words)
            if near:
                near[rnd.randrange(len(near))] = "Edit"
            rows.append((1000 + len(rows), "\t\n ".join(near)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "w1 w2"), (5003, rows[0][1]), (5003, rows[0][1])]
    rows.append((5004, "long " * 40_000))
    return rows


def test_fingerprint_is_the_definition():
    for _, text in corpus()[:120]:
        got = simhash.fingerprint(simhash.shingle_hashes((text or "").encode()))
        assert got & (1 << 64) - 1 == plain_fingerprint(text)
    assert simhash.fingerprint(np.zeros(0, np.uint64)) == 0


@pytest.mark.parametrize("tile", [3, 4096])
def test_against_all_pairs(spark, rows, tile):
    data = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in data], DOCS).repartition(3)
    got = rows(simhash.near_duplicates(docs, tile=tile).withColumn("component_id", F.col("component_id")))
    prints = [(i, plain_fingerprint(t)) for i, t in data]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints))]
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert got == sorted(want, key=key)


def test_tiles_of_a_crowded_band(spark):
    """Many fingerprints that share bands: the same components with any tile size."""
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 62, 6)
    marks = sorted({int(b) ^ sum(1 << int(k) for k in rnd.integers(0, 62, rnd.integers(0, 4))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(m,) for m in marks], "mark long")
    found = {tuple(r) for r in components(simhash.links(df, tile=5)).collect()}
    assert found == {tuple(r) for r in components(simhash.links(df)).collect()}
    want = plain_components([(m, m) for m in marks])
    assert found == {(m, c) for m, c in zip(marks, want) if m != c}


def test_keep_one_and_empty(spark, rows):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "A  b c d", "y"), (2, "z", "q"), (None, "a b c d", "n")], DOCS)
    assert rows(simhash.keep_one(docs), "doc_id", "mark") == [(1, "y"), (2, "q")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark, rows):
    """Rows are dropped by their place, not by their id: one row of each component stays."""
    near, alone = "red green blue cyan", [f"lone text number {w} of many" for w in ("ash", "elm", "oak", "fir")]
    data = [
        (1, near, "kept"), (None, near, "copy"),  # a null id beside a name
        (None, alone[0], "null a"), (None, alone[1], "null b"),  # null ids alone in their components
        (1, alone[2], "other text, same id"),
        (7, alone[3], "same id"), (7, alone[3].upper(), "same id"),  # a group of one id
        (None, "p q r s t", "nulls"), (None, "P  q r s t", "nulls"),  # a group of null ids
        (2, near, "same id"), (2, "u v w x y", "second text"),  # one id, dropped in one text only
    ]
    prints = [(k, plain_fingerprint(t)) for k, (_, t, _) in enumerate(data)]
    assert len(set(plain_components(prints))) == 7
    want = ["kept", "null a", "null b", "nulls", "other text, same id", "same id", "second text"]
    for parts in (1, 4):
        docs = spark.createDataFrame(data, DOCS).repartition(parts)
        assert [m for (m,) in rows(simhash.keep_one(docs), "mark")] == want
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {tuple(r) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(501, 500)}
