import random
import zlib

import numpy as np

from tessarea.llm import language as L

DOCS = "doc_id long, text string, lang string, score double, held_out string"
PARTS = {"en": ["the", "ing", "tion", "th", "wh", "ly"], "de": ["sch", "ung", "keit", "ß", "ver", "ö"], "xx": ["qua", "zo", "miq", "é", "ña"]}


def corpus(seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        lang = rnd.choice(["en", "en", "de", "xx", None])
        parts = PARTS[lang or "en"]
        text = " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 400)))
        rows.append((i, text, lang, 0.5, "c"))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus() + [(None, "die keitung", "de", None, None), (9000, None, "de", None, None), (9001, "", None, None, None),
                       (9002, "123 ... !", "en", None, None), (9003, "日本", None, None, None), (9004, "sch" * 40_000, None, None, None)]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    held = [r for r in rows[:600] if r[2] and got[r[0]].held_out]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    assert got[9003].lang_pred in PARTS and got[9004].lang_pred == "de" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None, None, None)], DOCS)
    assert [(r.lang_pred, r.score) for r in L.predict(docs).collect()] == [("und", 0.0)]
    assert L.predict(docs.limit(0)).count() == 0


def test_sample_is_the_smallest_hashes_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 7)
    rows = [(i, "abc", "en" if i % 3 else "de", None, None) for i in range(3000)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    texts, langs = L.sample(docs)
    assert sorted(langs) == ["de"] * 7 + ["en"] * 7 and set(texts) == {"abc"}
    got = L.predict(docs.limit(10).unionByName(docs.where("doc_id < 20")))
    assert got.count() == 10 + 40


def test_kernel_and_stretches():
    data = L.letters_of("Über  die 12 Häuser! " * 500)
    pieces = L.stretches(data)
    assert b"".join(p[1:-1] for p in pieces) == data and max(map(len, pieces)) <= L.STRETCH + 2
    assert set(L.codes(b"abc").tolist()) == {97, 98, 99, 97 << 8 | 98, 98 << 8 | 99, 97 << 16 | 98 << 8 | 99}
