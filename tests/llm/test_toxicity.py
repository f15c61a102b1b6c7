import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessarea.llm import toxicity as T

DOCS = "doc_id long, text string, score string, toxic string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900, seed=1):
    rnd = random.Random(seed)
    syllables = ["the", "on", "er", "in", "st", "ha", "ly", "ble", "ou", "re"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Grumblewort", "snarkface,", "zumpkin"]))
        docs.append((i, " ".join(words), "c", "c"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    docs += [(None, "zumpkin", "", ""), (5000, None, "", ""), (5001, "", "", ""), (5002, "s.n.a.r.k.f.a.c.e", "", ""),
             (5003, "z u m p k i n indeed", "", ""), (5004, "Grumblewoort", "", ""), (5005, "the " * 50_000, "", ""), (5006, "x" * 50_000, "", "")]
    labels += [(None, 1, 1), (1, None, None), (5001, 1, 0), (5001, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS).repartition(4)
    got = {r.doc_id: r for r in T.score(frame, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(docs)
    truth = {i: y for i, _, y in labels[:900]}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert [got[i].predicted for i in (None, 5000, 5001, 5002, 5003, 5004, 5005, 5006)] == [1, 0, 0, 1, 1, 1, 0, 0]


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "", ""), (2, None, "", "")], DOCS)
    for labels in ([], [(1, 1, 0), (2, 1, 0)]):
        got = T.score(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 2
    assert T.score(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_keep_clean_has_all_columns(spark):
    docs, labels = corpus(400)
    frame = spark.createDataFrame(docs, DOCS)
    kept = T.keep_clean(frame, spark.createDataFrame(labels, LABELS))
    assert kept.schema == frame.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, _, y in labels if not y}


def test_no_word_at_fault(spark, monkeypatch):
    """The constant is the share of all labels, whatever the bounds of the sample; nothing is dropped."""
    docs = spark.createDataFrame([(i, "the same words", "", "") for i in range(400)], DOCS)
    labels = [(i, 1, int(i % 10 == 0)) for i in range(400)]
    monkeypatch.setattr(T, "SAMPLE_CLEAN", 20)
    known = [y for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    frame = spark.createDataFrame(labels, LABELS)
    assert {(r.score, r.predicted) for r in T.score(docs, frame).collect()} == {(sum(known) / len(known), 0)}
    toxic = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(400)], LABELS)
    assert T.keep_clean(docs, toxic).count() == 400


def test_repeated_rows_each_have_a_row(spark):
    docs, labels = corpus(400)
    frame = spark.createDataFrame(docs + docs[:50] + docs[:50], DOCS)
    got = T.score(frame, spark.createDataFrame(labels, LABELS)).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("score").alias("d"))
    assert {(r.doc_id, r.n, r.d) for r in got.collect()} == {(i, 3 if i < 50 else 1, 1) for i in range(400)}


def test_kernel_is_the_sum_over_common_subsequences():
    def plain(a, b):
        def values(w):
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + T.SPAN)):
                        out.setdefault((w[i], w[j], w[k]), []).append(T.GAP ** (k - i - 2))
            return out
        x, y = values(a), values(b)
        norm = lambda v: sum(g * g for gs in v.values() for g in gs) ** 0.5
        return sum(sum(x[t]) * sum(y[t]) for t in x if t in y) / norm(x) / norm(y)

    kernel = T.Kernel(["idiot", "abcabc"])
    for word in ("idiot", "idxiot", "abcabc", "zzz", "cab"):
        assert np.allclose(kernel.values([word])[0], [plain(word, m) ** T.POWER for m in kernel.landmarks], rtol=1e-4)


def test_kernel_keeps_rows_for_the_triples_of_its_landmarks_only():
    """The table grows with the landmarks, not with all triples of letters, and gives the kernel's sums."""
    from itertools import combinations

    words = ["idiotic", "abcdefgh", "aaaa", "x1y2z3"]
    kernel = T.Kernel(words)
    assert kernel.table.nbytes < 10_000

    def triples(word):
        found = {}
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < T.SPAN:
                code = tuple(T._codes([word])[0][[i, j, k]])
                found.setdefault(code, []).append(T.GAP ** (k - i - 2))
        return found

    def norm(word):
        return np.sqrt(sum(w * w for ws in triples(word).values() for w in ws))

    for probe in ["idiotxc", "hgfedcba", "zzzzzzz", "aaa"]:
        a = triples(probe)
        want = [sum(sum(a[c]) * sum(b[c]) for c in a if c in b) / norm(probe) / norm(w) for w in words for b in [triples(w)]]
        assert np.allclose(kernel.values([probe])[0], np.array(want) ** T.POWER, rtol=1e-4, atol=1e-6)
    assert T.Kernel([]).values(["abc"]).shape == (1, 0)
