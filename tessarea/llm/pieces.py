"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of the model holds a whitespace marker behind another character,
nothing is ever merged across the start of a marked word, so a text's ids are those
of its chunks, each a run of markers and what follows up to the next. Texts are read
in blocks. A block deals its distinct chunks to buckets by hash; a bucket makes one
table of the distinct chunks of all blocks, segments and decodes each once, and
answers every block. The block's texts, as numbers of its list of chunks, are then
put together by position. A chunk travels once per block, however often it occurs, so
no bucket is hot; buckets are as many as shuffle partitions.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts_of
from .tokens import tokenizer_path

PIECES = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
# Code points of the texts of a block, about; a longer text is a block of its own.
BLOCK = 16_000_000
# Chunks that are segmented in one call.
TOGETHER = 4096

# A block's chunks of one bucket, and the answer to it; a block's text.
ASKED = "bucket int, block long, sizes binary, words binary"
ANSWERED = "home long, bucket int, counts binary, ids binary, sizes binary, surfaces binary"
TEXTS = "block long, doc_id long, numbers binary, buckets binary"


@functools.lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def splits_at_markers(path: str) -> bool:
    """Whether chunks may be segmented alone: by the pieces and by how texts are normalised.

    The model must leave texts as they are but for spaces, which become markers, and
    one marker in front.
    """
    sp = processor(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    plain = "  a  ﬁ é é\n\t　 "
    return all(MARK not in p.lstrip(MARK) for p in pieces) and sp.normalize(plain) == normalised(plain)


def normalised(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def chunks(text: str) -> list[str]:
    """The chunks of a text in order; together they are the normalised text."""
    return CHUNK.findall(normalised(text))


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers, the first bytes of all, then the second ones and so on, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _squeezed(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(text.encode())


def _cut(data: bytes, sizes: bytes) -> list[str]:
    """Strings from their joined text and their lengths."""
    text = zstandard.ZstdDecompressor().decompress(data).decode()
    ends = np.cumsum(_unpacked(sizes)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list, list[str]]]:
    """Blocks of a task: name, ids and texts.

    The same rows give the same blocks. A name holds the task's number, the block's
    and a checksum of the texts, so that a block read otherwise is missed, not mixed up.
    """
    part = TaskContext.get().partitionId()
    number, held, ids, size, check = 0, [], [], 0, 0

    def name() -> int:
        return (part << 44) + (number << 32) + check

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            if held and size + len(text) > limit:
                yield name(), ids, held
                number, held, ids, size, check = number + 1, [], [], 0, 0
            held.append(text)
            ids.append(doc_id)
            size += len(text)
            check = zlib.crc32(text.encode(), check)
    if held:
        yield name(), ids, held


def _numbered(texts: list[str]) -> tuple[dict[str, int], list[np.ndarray]]:
    """The distinct chunks of a block, numbered, and each text as numbers."""
    listed: dict[str, int] = {}
    return listed, [np.fromiter((listed.setdefault(c, len(listed)) for c in chunks(t)), "<u4") for t in texts]


def _buckets(words: Iterable[str], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64)


def _asked(limit: int, buckets: int):
    """A block's distinct chunks, one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, texts in _blocks(batches, limit):
            listed: dict[str, None] = {}
            for text in texts:
                listed.update(dict.fromkeys(chunks(text)))
            words = list(listed)
            of = _buckets(words, buckets)
            order = np.argsort(of, kind="stable")
            used, starts = np.unique(of[order], return_index=True)
            groups = [[words[i] for i in g.tolist()] for g in np.split(order, starts[1:])] if len(used) else []
            yield pa.record_batch(
                [
                    pa.array(used.astype(np.int32)),
                    pa.array([name] * len(groups), pa.int64()),
                    pa.array([_packed(np.array([len(w) for w in g])) for g in groups], pa.binary()),
                    pa.array([_squeezed("".join(g)) for g in groups], pa.binary()),
                ],
                ["bucket", "block", "sizes", "words"],
            )

    return run


def _answered(path: str):
    """The table of distinct chunks of a bucket: each is segmented and decoded once, for all blocks."""

    def run(asked: pa.Table) -> pa.Table:
        sp = processor(path)
        lists = [_cut(w, s) for w, s in zip(asked.column("words").to_pylist(), asked.column("sizes").to_pylist())]
        words = list(dict.fromkeys(w for some in lists for w in some))
        ids: dict[str, list[int]] = {}
        surfaces: dict[str, str] = {}
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            # The library puts the first marker in front by itself and takes it off again,
            # but not to an empty text.
            found = [i or [sp.piece_to_id(MARK)] for i in sp.encode([w[1:].replace(MARK, " ") for w in some], num_threads=1)]
            ids.update(zip(some, found))
            surfaces.update(zip(some, (" " + t for t in sp.decode(found, num_threads=1))))
        rows = []
        for some in lists:
            told, shown = [ids[w] for w in some], [surfaces[w] for w in some]
            rows.append(
                (
                    _packed(np.array([len(i) for i in told])),
                    _packed(np.fromiter(chain.from_iterable(told), np.int64)),
                    _packed(np.array([len(t) for t in shown])),
                    _squeezed("".join(shown)),
                )
            )
        return pa.table(
            [asked.column("block"), asked.column("bucket"), *(pa.array(c, pa.binary()) for c in zip(*rows))],
            ["home", "bucket", "counts", "ids", "sizes", "surfaces"],
        )

    return run


def _written(limit: int, buckets: int):
    """Each text as chunk numbers; the first row of a block has the buckets of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, doc_ids, texts in _blocks(batches, limit):
            listed, numbers = _numbered(texts)
            first = [_packed(_buckets(listed, buckets))] + [None] * (len(texts) - 1)
            yield pa.record_batch(
                [
                    pa.array([name] * len(texts), pa.int64()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array([_packed(n) for n in numbers], pa.binary()),
                    pa.array(first, pa.binary()),
                ],
                ["block", "doc_id", "numbers", "buckets"],
            )

    return run


def _joined(make, names: list[str], types: list[pa.DataType]):
    """Texts of a block, put together from the answers of its buckets by ``make``."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        told = {r["bucket"]: r for r in answers.to_pylist()}
        known = next((_unpacked(b) for b in texts.column("buckets").to_pylist() if b is not None), None)
        if known is None or set(np.unique(known).tolist()) != set(told):
            raise RuntimeError("a block of texts was not read as before")
        order = np.argsort(known, kind="stable").tolist()
        ids: list = [None] * len(order)
        surfaces: list = [None] * len(order)
        at = 0
        for bucket in sorted(told):
            r = told[bucket]
            ends = np.cumsum(_unpacked(r["counts"])).tolist()
            flat = _unpacked(r["ids"])
            for a, b, shown in zip([0, *ends], ends, _cut(r["surfaces"], r["sizes"])):
                ids[order[at]], surfaces[order[at]] = flat[a:b], shown
                at += 1
        made = make(ids, surfaces)
        rows = [
            (doc_id, *made(_unpacked(numbers).tolist()))
            for doc_id, numbers in zip(texts.column("doc_id").to_pylist(), texts.column("numbers").to_pylist())
        ]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _ids_and_text(ids: list[np.ndarray], surfaces: list[str]):
    packed = [i.tobytes() for i in ids]

    def made(numbers: list[int]) -> tuple:
        return b"".join(map(packed.__getitem__, numbers)), "".join(map(surfaces.__getitem__, numbers))[1:]

    return made


def _digests(ids: list[np.ndarray], surfaces: list[str]):
    """Digests straight from the chunks' own decimal ids and surfaces."""
    counts = [len(i) for i in ids]
    decimal = [",".join(map(str, i.tolist())) for i in ids]

    def made(numbers: list[int]) -> tuple:
        told = ",".join(map(decimal.__getitem__, numbers))
        text = "".join(map(surfaces.__getitem__, numbers))[1:]
        return (
            sum(map(counts.__getitem__, numbers)),
            hashlib.sha256(told.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )

    return made


def _run(docs: DataFrame, path: str | None, block: int, make, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    prepare(docs.sparkSession)
    path = path or tokenizer_path(PIECES)
    if not splits_at_markers(path):
        raise ValueError("this model's pieces cross whitespace markers, or it changes texts: chunks cannot stand alone")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts are cut twice rather than stored as numbers in between: that halves the disk.
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = rows.mapInArrow(_asked(block, buckets), ASKED).groupBy("bucket").applyInArrow(_answered(path), ANSWERED)
    texts = rows.mapInArrow(_written(block, buckets), TEXTS)
    return texts.groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(_joined(make, names, types), schema)


def encode(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """``doc_id, ids, text``: the library's ids (little-endian unsigned 32-bit) and what it decodes them to.

    ``docs`` has ``doc_id, text``; no begin or end ids, no sampling. A null or empty
    text has no ids and decodes to an empty one. Each row is a document of its own,
    repeated or null ids included; a text of any length is one block. An empty table
    gives no rows. Other columns are not read. A model whose pieces cross whitespace
    markers, or that normalises texts, is refused.
    """
    return _run(
        docs, path, block, _ids_and_text, "doc_id long, ids binary, text string",
        ["doc_id", "ids", "text"], [pa.int64(), pa.binary(), pa.string()],
    )


def digests(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the same ids and decoded texts."""
    return _run(
        docs, path, block, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()],
    )
