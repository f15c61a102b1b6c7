import hashlib
import random

import pytest

from tessarea.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, budget string"


def water(total, nodes):
    """Raise a common level step by step: name -> (weight, capacity)."""
    got = {n: 0.0 for n in nodes}
    live, left = set(nodes), total
    while live and left > 1e-9:
        each = left / sum(nodes[n][0] for n in live)
        full = {n for n in live if nodes[n][1] - got[n] <= each * nodes[n][0] + 1e-12}
        if not full:
            for n in live:
                got[n] += each * nodes[n][0]
            return got
        for n in full:
            left -= nodes[n][1] - got[n]
            got[n] = nodes[n][1]
        live -= full
    return got


def plain_mix(rows, share, epochs, seed):
    words = {}
    for i, (doc, text, lang, source) in enumerate(rows):
        tokens = max(1, len((text or "").encode().split()))
        source = "(none)" if source is None else source
        domain = f"d{int(hashlib.md5(source.encode()).hexdigest()[0], 16) // 4}"
        words.setdefault((domain, lang or "(none)", source), []).append((doc, tokens))
    supply = {k: sum(t for _, t in v) for k, v in words.items()}
    total = sum(supply.values()) * share

    def below(prefix):
        return epochs * sum(s for k, s in supply.items() if k[: len(prefix)] == prefix)

    out = []
    domains = {k[0] for k in supply}
    given = water(total, {d: (2 if d == "d0" else 1, below((d,))) for d in domains})
    for d in domains:
        langs = {k[1] for k in supply if k[0] == d}
        by_lang = water(given[d], {g: (1, below((d, g))) for g in langs})
        for g in langs:
            leaves = {k[2] for k in supply if k[:2] == (d, g)}
            for s, budget in water(by_lang[g], {s: (1, below((d, g, s))) for s in leaves}).items():
                leaf = (d, g, s)
                left = int(budget + 0.5)
                for epoch in range(epochs):
                    room, used = min(supply[leaf], left - epoch * supply[leaf]), 0
                    order = sorted(words[leaf], key=lambda r: hashlib.md5(f"{seed}:{epoch}:{r[0]}".encode()).hexdigest())
                    for doc, tokens in order:
                        if used < room:
                            out.append((doc, epoch, *leaf, tokens))
                        used += tokens
    return sorted(out)


@pytest.mark.parametrize("share", [0.05, 0.6, 1.4, 5.0])
def test_against_step_by_step_filling(spark, rows, share):
    rnd = random.Random(3)
    data = []
    for i in range(400):
        source = "s0" if i % 3 == 0 else rnd.choice(["s1", "s2", "s3", "s4", None, ""])
        text = rnd.choice([None, "", " \n ", "a b\tc", "w " * rnd.randrange(300)])
        data.append((i, text, rnd.choice(["en", "de", None]), source))
    docs = spark.createDataFrame([(*r, 0, "x") for r in data], DOCS)
    got = mixing.mix(docs, share=share, epochs=3, seed=5).drop("tie")
    assert rows(got) == plain_mix(data, share, 3, 5)


def test_apply_keeps_columns_and_copies(spark, rows):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, "x"), (2, "c", "en", "s", 1, "y"), (None, None, None, None, None, None)], DOCS)
    all_twice = mixing.apply_mix(docs, share=9.0, epochs=2)
    assert all_twice.columns == docs.columns
    assert rows(all_twice, "doc_id", "budget") == [(1, "x"), (1, "x"), (2, "y"), (2, "y"), (None, None), (None, None)]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_no_window_spans_a_leaf(spark):
    """Only the bucket that a budget cuts is ordered."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'a b c' AS text", "'en' AS lang", "'s' AS source")
    got = mixing.mix(docs, share=0.5, epochs=1)
    assert got.count() == 10_000


def test_apply_is_the_selection(spark, rows):
    rnd = random.Random(8)
    docs = spark.createDataFrame(
        [(i, "w " * rnd.randrange(1, 50), rnd.choice(["en", None]), f"s{i % 3}", i, "x") for i in range(500)], DOCS
    )
    for share in (0.3, 1.2):
        want = rows(mixing.mix(docs, share=share), "doc_id")
        assert rows(mixing.apply_mix(docs, share=share), "doc_id") == want
