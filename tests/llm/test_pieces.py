import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
import sentencepiece

from tessarea.llm import pieces
from tessarea.llm.queries import QUERIES
from tessarea.llm.tokens import tokenizer_path

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def plain():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.PIECES))


def texts():
    rnd = random.Random(5)
    odd = ["", " ", "  ", "a ", " a", "a  b   c" + " " * 40 + "d", "▁", "▁▁x▁y ▁ z", "tab\tnew\n\nline\r", "日本 語　x", "é́ ﬁ",
           "<s> </s> <unk> <0x41>", "\x00 nul\x00", "🙂🙂 👩‍👩‍👧", "x" * 5000, " nbsp", "ab" * 20000 + " end"]
    return odd + [" ".join(rnd.choice(["word", "Ofenoron,", "é", "12", "it's", "▁", ""]) for _ in range(n)) for n in (3, 50, 3000)]


@pytest.mark.parametrize("block", [1, 1000, pieces.BLOCK])
def test_ids_and_texts_are_the_library_s(spark, plain, block):
    data = [*enumerate(texts()), (None, "no id"), (900, None), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], "doc_id long, text string, chunk string, block int")
    found = pieces.encode(docs.repartition(3), block=block).collect()
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in found)
    assert got == sorted((str(i), plain.encode(t or ""), plain.decode(plain.encode(t or ""))) for i, t in data)


def test_chunks_are_the_normalised_text(plain):
    for text in texts():
        if "\x00" not in text:
            assert "".join(pieces.chunks(text)) == plain.normalize(text)


def test_empty_table_and_unfit_models(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(docs).collect() == [] and pieces.digests(docs).collect() == []
    monkeypatch.setattr(pieces, "splits_at_markers", lambda path: False)
    with pytest.raises(ValueError):
        pieces.encode(docs)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_against_the_library(spark, plain):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF_DIR}/documents.parquet'").fetchall()
    want = set()
    for i, text in rows:
        ids = plain.encode(text)
        name = ",".join(map(str, ids)).encode(), plain.decode(ids).encode()
        want.add((i, len(ids), *(hashlib.sha256(b).hexdigest() for b in name)))
    got = QUERIES["op12_sentencepiece"](spark, SF_DIR).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
