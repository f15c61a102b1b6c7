"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps ``OPEN`` windows open. What is left of a document after its
full windows goes into the window that it fills best; when it fits none, the
fullest is emitted and a new one opened. The windows still open at the end of the
partitions are merged: their pieces are packed anew, best fit by falling length,
in groups of a fixed number of partitions, so that no task sees them all.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, prepare, texts_of, tidy
from .tokens import encoder, tokenizer_path

WINDOW = 2048
END = 1
OPEN = 64
# Partitions whose open windows are merged in one group.
MERGED = 16

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


class Packer:
    """Open windows of one partition. A piece is ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, window: int, open_windows: int | None, first_id: int):
        self.window, self.limit, self.next_id = window, open_windows, first_id
        self.room: list[tuple[int, int]] = []  # free tokens and number of each open window, sorted
        self.held: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def _emit(self, number: int, is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in self.held.pop(number):
            length = len(ids) // 4
            self.out.append((doc_id, start, length, ids, total, number, offset, is_open))
            offset += length

    def place(self, piece: tuple) -> None:
        """Put a piece of at most one window where it fits best."""
        need = len(piece[2]) // 4
        at = bisect_left(self.room, (need, -1))
        if at < len(self.room):
            free, number = self.room.pop(at)
        else:
            if self.limit is not None and len(self.room) >= self.limit:
                self._emit(self.room.pop(0)[1])  # the fullest
            free, number = self.window, self.next_id
            self.next_id += 1
            self.held[number] = []
        self.held[number].append(piece)
        if free == need:
            self._emit(number)
        else:
            insort(self.room, (free - need, number))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Cut a document into full windows and a rest."""
        total, step = len(ids) // 4, self.window * 4
        for k in range(0, len(ids), step):
            self.place((doc_id, k // 4, ids[k : k + step], total))

    def close(self, still_open: bool) -> None:
        for _, number in self.room:
            self._emit(number, still_open)
        self.room = []

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [[] for _ in NAMES]
        self.out = []
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def _pack(path: str, window: int, open_windows: int, end: int):
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(texts_of(batch.column(1)))):
                packer.add(doc_id, ids + mark)
            if packer.out:
                yield packer.take()
        packer.close(still_open=True)
        yield packer.take()

    return run


def _merge(window: int):
    def run(found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        rows.sort(key=lambda r: (-r["length"], r["sequence_id"], r["offset"]))
        packer = Packer(window, None, (1 << 62) + (rows[0]["merge"] << 33))
        for r in rows:
            packer.place((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        packer.close(still_open=False)
        return pa.Table.from_batches([packer.take()])

    return run


def pack(
    docs: DataFrame, path: str | None = None, window: int = WINDOW, open_windows: int = OPEN, end: int = END
) -> DataFrame:
    """Pieces of the documents ``docs(doc_id, text)`` and their place in sequences.

    ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``. Each document is its token ids and the id ``end``; a null
    or empty text is that id alone. Every id lies in exactly one piece. Each row is
    a document of its own, repeated or null ids included. An empty table gives no
    rows. Other columns are not read. Window numbers follow from the partition.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(tidy("tokens", _pack(path or tokenizer_path(), window, open_windows, end)), SCHEMA)
    stored = cut_lineage(packed, "packed")
    done = stored.where("NOT open")
    rest = stored.where("open").withColumn("merge", F.shiftright("sequence_id", 33).cast("long") % _groups(spark, stored))
    merged = rest.groupBy("merge").applyInArrow(_merge(window), SCHEMA)
    return done.unionByName(merged).drop("open")


def _groups(spark, stored: DataFrame) -> int:
    """Groups of about ``MERGED`` partitions."""
    last = stored.where("open").agg(F.max(F.shiftright("sequence_id", 33))).first()[0] or 0
    return int(last) // MERGED + 1


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
