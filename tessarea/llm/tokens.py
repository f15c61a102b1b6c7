"""Token ids by a public tokenizer, with a memory of the words seen."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Collection
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

WORD_BPE = "word_bpe_49k.json"
# Bytes of words and ids that a worker remembers, what an entry takes beside its text
# and ids (two objects and a place in the table), and the longest word remembered.
REMEMBERED, ENTRY, LONGEST = 96_000_000, 190, 64
# New words that are encoded in one call, which bounds what the tokenizer takes meanwhile.
AT_ONCE = 20_000
# What closes the last token of a word in the vocabulary, and words encoded together.
WORD_END = "</w>"
TOGETHER = 50


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# A full stop or comma that ends a word after an ASCII letter or digit, and signs that the tokenizer splits off any letters before them.
_SIGN = re.compile(rb"[.,](?<=[A-Za-z0-9].)(?= |$)")
_SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
# White space becomes a space; A to Z in lower case too. Characters from U+0300 on, which may change the letter before them, begin with this byte or a larger one.
_BLANK = bytes.maketrans(b"\n\t\r", b"   ")
_LOWER = bytes(_BLANK[c] for c in bytes(range(256)).lower())
_COMPOSING = 0xCC
# How a tokenizer must prepare texts, so that words of a to z need no preparation.
_NORMALIZERS, _PRE_TOKENIZERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]


def _spaced(text: str) -> bytes:
    """A text in UTF-8 whose words have spaces between them.

    Without special tokens their final signs are split off, and A to Z lowered where safe.
    """
    data = text.encode()
    if b"<" in data:
        return data.translate(_BLANK)
    safe = data.isascii() or np.frombuffer(data, np.uint8).max() < _COMPOSING
    return _SIGN.sub(rb" \g<0>", data.translate(_LOWER if safe else _BLANK))


def _core(word: str) -> tuple[str, str]:
    """A word in lower case without its final signs, and those signs.

    The tokenizer lowers case itself and splits a full stop or comma off when a letter
    or digit stands before it, and ASCII signs other than an apostrophe when only letters
    stand before them. Words beyond Latin-1, whose case or composition may
    depend on neighbours, and special tokens stay as they are.
    """
    if "<" in word or not (word.isascii() or max(word) <= "\xff"):
        return word, ""
    if len(word) > 1 and word[-1] in ".," and word[-2].isalnum():
        return word[:-1].lower(), word[-1]
    core = word.rstrip(_SIGNS)
    if core.isalpha():
        return core.lower(), word[len(core) :]
    return word.lower(), ""


class WordEncoder:
    """Ids of whole texts for tokenizers that never join across white space.

    ``word_bpe_49k`` drops white space and splits before it merges, so the ids of
    a text are those of its words in turn; each word is encoded once. The memory of
    words is bounded in bytes (``REMEMBERED``); when it is full, its older half goes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.closes[number] = token.endswith(WORD_END)
        self.letters = self._unprepared(path)
        self.known: dict[str, bytes] = {"": b""}
        self.bytes = 0

    def _unprepared(self, path: str):
        """The same merges cut at white space only, for words of a to z; the tokenizer itself where it prepares texts otherwise."""
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        names = [
            [step["type"] for step in (parts[key] or {}).get(steps, [])]
            for key, steps in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
        ]
        if names != [_NORMALIZERS, _PRE_TOKENIZERS]:
            return self.tokenizer
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        return type(self.tokenizer).from_str(json.dumps(parts))

    def _batch(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word, some words at a time."""
        return [ids for k in range(0, len(words), AT_ONCE) for ids in self._some(words[k : k + AT_ONCE])]

    def _some(self, words: list[str]) -> list[bytes]:
        """Words of letters alone close one token each: many go in one text."""
        found: dict[str, bytes] = {}
        plain, other = [], []
        for w in words:
            if w.isalpha():
                (plain if w.isascii() and w.islower() else other).append(w)
        for alike, tokenizer in ((plain, self.letters), (other, self.tokenizer)):
            groups = [alike[k : k + TOGETHER] for k in range(0, len(alike), TOGETHER)]
            for group, ids in zip(groups, self._batch([" ".join(g) for g in groups], tokenizer)):
                ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
                if len(ends) == len(group) and ends[-1] == len(ids):
                    data = ids.tobytes()
                    found.update(zip(group, (data[4 * a : 4 * b] for a, b in zip([0, *ends], ends))))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, (ids.tobytes() for ids in self._batch(rest))))
        return [found[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        collects = gc.isenabled()
        gc.disable()  # very many small objects, and no cycles
        try:
            return self._ids_of(texts)
        finally:
            if collects:
                gc.enable()

    def _forget(self) -> None:
        """Drop the older half of the words, without a second table of those that stay."""
        known = self.known
        for word in list(islice(known, len(known) // 2)):
            if word:
                self.bytes -= ENTRY + len(word) + len(known.pop(word))

    def _ids_of(self, texts: list[str]) -> list[bytes]:
        """Each distinct word of the texts is looked up once; Arrow cuts the texts and puts their ids together."""
        if self.bytes > REMEMBERED:
            self._forget()
        spaced = pa.array(map(_spaced, texts), pa.large_binary(), size=len(texts))
        split = pc.split_pattern(spaced, b" ")
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        if None in found:
            at = [k for k, ids in enumerate(found) if ids is None]
            for k, ids in zip(at, self._learn([words[k] for k in at])):
                found[k] = ids
        placed = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, data = placed.buffers()
        if data is None or not len(placed):
            return [b""] * len(texts)
        cuts = np.frombuffer(ends, np.int64)[np.asarray(split.offsets)].tolist()
        view = memoryview(data)
        return [bytes(view[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of distinct new words; those that are not too long stay known."""
        known = self.known
        parts = {}
        for w in new:
            if not (w.isascii() and w.isalpha() and w.islower()):
                pair = _core(w)
                if pair[1] or pair[0] != w:
                    parts[w] = pair
        whole = set(new).difference(parts)
        whole.update(core for core, _ in parts.values())
        whole.update({sign for _, sign in parts.values()})
        words = list(whole.difference(known))
        known.update(zip(words, self._encode(words)))
        for word, (core, sign) in parts.items():
            known[word] = known[core] + known[sign]
        found = list(map(known.__getitem__, new))
        words += parts
        for word in [w for w in words if len(w) > LONGEST]:
            known.pop(word, None)
        self._count(words := [w for w in words if len(w) <= LONGEST], list(map(known.__getitem__, words)))
        return found

    def _count(self, words: Collection[str], ids: Collection[bytes]) -> None:
        self.bytes += ENTRY * len(words) + sum(map(len, words)) + sum(map(len, ids))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; it stays over tasks. What other operators left in the worker goes."""
    state = worker_state("tokens")
    if state.get("path") != path:
        state.update(path=path, encoder=WordEncoder(path))
    return state["encoder"]
