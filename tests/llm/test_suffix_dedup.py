import hashlib
import random

import numpy as np
import pytest

from tessarea.llm import suffix_dedup as S

DOCS = "doc_id long, text string, row string, file string"


def plain(texts):
    """Spans by a table of all strings of 200 bytes."""
    seen = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - 199):
            seen.setdefault(t[a : a + 200], []).append((i, a))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i][a : a + 200] = True
    out = []
    for t, g in zip(texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        edge = np.diff(np.concatenate([[0], g.astype(int)]))
        out.append((len(t), int(g.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=4):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "ofen", "tion ", "é", "x", "日本", "haon"]) + str(rnd.randrange(60))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(k) for k in (30, 45, 60, 200)]
    exact = (prose(80).encode()[:200]).decode(errors="ignore")
    texts = [prose(rnd.randrange(0, 300)) for _ in range(40)]
    for _ in range(60):  # passages in new surroundings
        texts.append(prose(rnd.randrange(20)) + rnd.choice(passages) + prose(rnd.randrange(20)))
    for t in texts[:12]:  # exact and near copies
        texts += [t, t[: len(t) // 2] + "#" + t[len(t) // 2 :], t[7:]]
    texts += ["a" * 200, "a" * 199, "b" * 201, "ab" * 150, "abc" * 1000, "", None, "z" * 5000, passages[3] * 3]
    texts += [prose(5) + exact + "1", prose(6) + exact + "2", exact]
    return texts


@pytest.mark.parametrize("crowd", [1, 2048])
def test_against_a_table_of_all_strings(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    texts = corpus()
    docs = spark.createDataFrame([(i if i % 7 else None, t, "c", "c") for i, t in enumerate(texts)], DOCS).repartition(5)
    got = sorted(
        (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in S.remove_repeats_of(docs).collect()
    )
    assert got == sorted(plain([(t or "").encode() for t in texts]))


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert S.remove_repeats_of(docs).count() == 0
    short = spark.createDataFrame([(1, "short", "", ""), (2, None, "", "")], DOCS)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in S.remove_repeats_of(short).collect()) == [(1, 5, 0), (2, 0, 0)]


@pytest.mark.parametrize("reach", [3, 9, 25])
def test_ranks_order_suffixes(reach):
    rnd = np.random.default_rng(reach)
    for n in (1, 2, 3, 4, 7, 50, 400):
        letters = rnd.integers(1, 4, n)
        rank = S.ranks(letters, reach)
        prefix = [tuple(letters[i : i + reach].tolist()) for i in range(n)]
        order = sorted(range(n), key=lambda i: rank[i])
        assert [prefix[i] for i in order] == sorted(prefix)


def test_repeated_starts():
    rnd = random.Random(9)
    for alphabet in (b"ab", b"abcdefgh"):
        contexts = [bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(200, 320))) for _ in range(12)]
        contexts += [contexts[0][20:] + b"qq", b"xx" + contexts[1][:210], b"a" * 260]
        owner, start = S.repeated_starts(contexts)
        got = set(zip(owner.tolist(), start.tolist()))
        seen = {}
        for i, c in enumerate(contexts):
            for a in range(len(c) - 199):
                seen.setdefault(c[a : a + 200], []).append((i, a))
        assert got == {p for places in seen.values() if len(places) > 1 for p in places}
