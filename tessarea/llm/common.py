"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarea.session import cut_lineage, scratch_path, ship, tune

__all__ = ["cut_lineage", "prepare", "scratch_path", "text_bytes", "texts_of", "crc_of_id", "WHITE", "cells"]

# ASCII white space, as the operators' contracts define it.
WHITE = r"[\x20\x09-\x0D]+"
# Rows per Arrow batch: a batch holds whole texts, so it is kept small.
BATCH_ROWS = 512
# What operators keep in a Python worker over tasks, by operator.
_STATES: dict[str, dict] = {}


def worker_state(name: str) -> dict:
    """A dictionary that stays in the worker over tasks; those of all other operators are emptied."""
    for other, state in _STATES.items():
        if other != name:
            state.clear()
    return _STATES.setdefault(name, {})


def tidy(name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` of operator ``name`` for ``mapInArrow``, giving free memory back after each batch and each task.

    It starts without what other operators left in the worker. Workers outlive their
    tasks, and what their allocators keep adds to the executor's memory while it runs
    stages without Python.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(name)
        pool = pa.default_memory_pool()
        try:
            for batch in run(batches):
                yield batch
                del batch
                pool.release_unused()
        finally:
            pool.release_unused()
            _trim()

    return tidied


def _trim() -> None:
    """Return the free pages of the C heap, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings, and the package on the executors' Python path."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)
    return spark


def crc_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of an id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of one Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of one Arrow column of texts; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Small batches joined to ones of about ``rows`` rows; none is empty."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, count = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def cells(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 32_768) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by ``keys``, so that no key is cut in two.

    Holds about ``rows`` rows and those of one key; a table yields many whole keys.
    """
    import numpy as np

    waiting: list[pa.RecordBatch] = []

    def last_start(batch: pa.RecordBatch) -> int:
        differs = np.zeros(batch.num_rows, bool)
        differs[0] = True
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            differs[1:] |= values[1:] != values[:-1]
        return int(np.flatnonzero(differs)[-1])

    def key_at(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in gathered(batches, rows):
        if waiting and key_at(waiting[-1], waiting[-1].num_rows - 1) != key_at(batch, 0):
            yield pa.Table.from_batches(waiting)
            waiting = []
        start = last_start(batch)
        if start:
            yield pa.Table.from_batches([*waiting, batch.slice(0, start)])
            waiting = []
        waiting.append(batch.slice(start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
