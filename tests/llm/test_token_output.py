import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessarea.llm import token_output as O
from tessarea.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string, slot string, part string"


@given(st.integers(0, 3000), st.integers(0, 2**70))
@settings(max_examples=60, deadline=None)
def test_permutation_is_a_bijection(count, key):
    out = O.permute(np.arange(count), count, key)
    assert sorted(out.tolist()) == list(range(count))


def test_permutation_depends_on_the_key_and_on_large_numbers():
    assert not np.array_equal(O.permute(np.arange(500), 500, 1), O.permute(np.arange(500), 500, 2))
    at = np.array([0, 1, 2**39, 2**40 - 1])
    assert len(set(O.permute(at, 2**40).tolist())) == 4


@pytest.mark.parametrize("shard", [1, 7, 1000])
def test_round_trip(spark, tmp_path, shard):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["word", "Été,", "x1"]) for _ in range(rnd.randrange(200))) for _ in range(120)] + [None, "", "z " * 5000]
    spark.createDataFrame([(1, t, "c", "c") for t in texts], DOCS).repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = str(tmp_path / "shards")
    O.write_shards(docs, out, length=32, shard=shard)
    found = O.read_slots(spark, out, shard=shard).orderBy("slot").collect()
    assert [r.slot for r in found] == list(range(len(found)))
    assert sorted(r.origin for r in found) == list(range(len(found)))
    assert all(r.slot == O.permute(np.array([r.origin]), len(found))[0] for r in found)
    assert all(r.byte_offset == (r.slot - r.shard * shard) * 64 and r.shard == r.slot // shard for r in found)
    ids = [np.frombuffer(r.ids, "<u2") for r in found]
    assert all(len(i) == 32 and (i[r.n_tokens :] == O.PAD).all() for i, r in zip(ids, found))
    # In the order of origin the stream of every partition comes back.
    stream = np.concatenate([i[: r.n_tokens] for r, i in sorted(zip(found, ids), key=lambda p: p[0].origin)])
    plain = Tokenizer.from_file(tokenizer_path())
    parts = docs.rdd.glom().map(lambda rows: [r.text for r in rows]).collect()
    want = [x for rows in parts for t in rows for x in plain.encode(t or "", add_special_tokens=False).ids + [O.END]]
    assert stream.tolist() == want
    # A reader resumes anywhere.
    later = O.read_slots(spark, out, first=len(found) // 2, shard=shard).orderBy("slot").collect()
    assert [(r.slot, r.ids) for r in later] == [(r.slot, r.ids) for r in found[len(found) // 2 :]]


def test_empty(spark, tmp_path):
    out = str(tmp_path / "none")
    O.write_shards(spark.createDataFrame([], DOCS), out)
    assert O.read_slots(spark, out).count() == 0
