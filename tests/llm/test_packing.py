import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessarea.llm import packing
from tessarea.llm.tokens import WordEncoder, tokenizer_path

DOCS = "doc_id long, text string, length string, offset string"


def texts():
    rnd = random.Random(2)
    odd = ["", " ", "It's   we'll\n\n don't", "É́ á\x0b\x0cb", "x<|endoftext|>y <|startoftext|>", "日本 語　x\x85y\x1cz",
           "A" * 500, "12345 a1b2", "İI ΣΑΣ", "́ ́a", "tab\there\r\nnew", "\xa0 \xa0x"]
    words = ["thing", "Ofenoron,", "loweischaft", "é", "12", "it's"] + odd
    return odd + [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 40, 900]))) for _ in range(60)]


def test_words_one_by_one_give_the_ids_of_the_text():
    plain = Tokenizer.from_file(tokenizer_path())
    encoder = WordEncoder(tokenizer_path())
    for _ in range(2):
        for text, ids in zip(texts(), encoder.encode(texts())):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("partitions,window,open_windows", [(3, 64, 2), (20, 2048, 64), (1, 1, 1)])
def test_pieces_are_a_partition_of_all_ids(spark, partitions, window, open_windows):
    data = list(enumerate(texts())) + [(None, "no id"), (900, None), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in data], DOCS).repartition(partitions)
    found = packing.pack(docs, window=window, open_windows=open_windows).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    want, got = defaultdict(int), defaultdict(int)
    for i, t in data:
        for k, x in enumerate(plain.encode(t or "", add_special_tokens=False).ids + [1]):
            want[i, k, x] += 1
    sequences = defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        for k, x in enumerate(ids.tolist()):
            got[r.doc_id, r.start + k, x] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    digest = {(r.doc_id, r.start, r.ids_crc32) for r in packing.digest(packing.pack(docs, window=window)).collect()}
    assert any(d == (900, 0, zlib.crc32(np.array([1], "<u4").tobytes())) for d in digest)


def test_fullest_goes_first_and_best_fit():
    p = packing.Packer(10, 2, 0)
    ids = lambda n: b"\0" * 4 * n
    p.add(1, ids(6))
    p.add(2, ids(7))
    p.add(3, ids(3))  # fills the window of 7 exactly
    assert [(r[0], r[5], r[6]) for r in p.out] == [(2, 1, 0), (3, 1, 7)]
    p.add(4, ids(8))
    p.add(5, ids(9))  # none fits: the window of 8 is the fullest
    assert (p.out[-1][0], p.out[-1][5]) == (4, 2)
    p.close(True)
    assert sorted(r[0] for r in p.out if r[-1]) == [1, 5]


def test_little_padding_and_empty(spark):
    rnd = random.Random(1)
    docs = spark.createDataFrame([(i, "word " * rnd.randrange(1, 3000), "", "") for i in range(500)], DOCS).repartition(24)
    found = packing.pack(docs).groupBy("sequence_id").sum("length").collect()
    assert sum(2048 - r[1] for r in found) < 0.03 * sum(r[1] for r in found)
    assert packing.pack(docs.limit(0)).count() == 0


def test_signs_and_case_of_whole_texts_change_no_ids_and_fill_no_memory():
    """A word at the end of a sentence, or in capitals, is remembered once; what follows it decides nothing."""
    odd = ["Éa. Tail, a.. b,. c., d... 1. 2, É. ñ, x.", "J̌ J. Ǩ, İ. İa. ΣΑΣ. end.", "A<|endoftext|>. B, C.", "word.\nWORD,\tWord.\rword",
           "a.\x0bb.\x0cc.", "a.\xa0b, .a ,b .", "It's. WE'LL, don't.", "ﬁx. K. K, \xb2. a\xb2, ss. ß."]
    plain = Tokenizer.from_file(tokenizer_path())
    encoder = WordEncoder(tokenizer_path())
    for text, ids in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    letters = ["thing", "loweischaft", "a", "zzyzx", "ing", "qqqq"]
    for word, ids in zip(letters, encoder._batch(letters, encoder.letters)):
        assert ids.tolist() == plain.encode(word, add_special_tokens=False).ids
    once = WordEncoder(tokenizer_path())
    once.encode(["Loweischaft loweischaft, LOWEISCHAFT. é"])
    assert {w for w in once.known if "schaft" in w.lower()} == {"loweischaft"}


def test_letters_and_the_signs_after_them_are_encoded_apart(monkeypatch):
    """A word with signs behind it costs no encoding of its own, also where an apostrophe, digit or long word stands there."""
    odd = ["Thing*** thing### thing??! thing,. Thing", "été*** É!! ñ-. x'. it's' a'' a'*", "1*** 1.. ²** a² a1!! _ a_ _a **", "ĳ** ſ!! ʼ?? ª@@ µ$ ß%% ́** é**",
           "b**<|endoftext|>** c<d>** c<", "z" * 200 + "***", "***\n###\t. , ,. ., a,b. a.b,c"]
    plain = Tokenizer.from_file(tokenizer_path())
    encoder = WordEncoder(tokenizer_path())
    encoded, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda words: [encoded.extend(words), encode(words)][1])
    for _ in range(2):
        for text, ids in zip(odd, encoder.encode(odd)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert "thing" in encoded and not any("thing" in w.lower() and w != "thing" for w in encoded)
    assert not any(len(w) > 64 for w in encoder.known)


def test_forgetting_needs_no_second_table(monkeypatch):
    encoder = WordEncoder(tokenizer_path())
    known = encoder.known
    encoder.encode(["one two three four"])
    full = encoder.bytes
    monkeypatch.setattr("tessarea.llm.tokens.REMEMBERED", full - 1)
    assert encoder.encode(["", "five"])[0] == b""
    assert encoder.known is known and known[""] == b"" and len(known) < 6
    assert encoder.bytes == sum(190 + len(w) + len(ids) for w, ids in known.items() if w)
