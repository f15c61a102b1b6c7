"""Token-id output in training order.

The token stream of each input partition is cut into sequences of one length.
A keyed Feistel permutation over the next power of four, walked until it falls
below the number of sequences, gives every sequence a slot of its own. Slots are
range-partitioned by shard and written in order: a shard is one record of
``SHARD`` sequences of fixed stride, so the bytes of a slot follow from its number
and a reader resumes at any slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, prepare, scratch_path, texts_of, tidy
from .tokens import encoder, tokenizer_path

LENGTH = 2048
END = 1
PAD = 0
SHARD = 1024
KEY = 20_240_607
ROUNDS = 6
# Ids of the default vocabulary fit in two bytes.
ID_TYPE = "<u2"

SEQUENCES = "part int, local long, used int, records binary"
SHARDS = "shard long, first_slot long, slots long, stride int, used array<int>, origin array<long>, records binary"


def _round(right: np.ndarray, key: int, number: int) -> np.ndarray:
    """A mixing of 64 bits (the finaliser of SplitMix64)."""
    x = right + np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1342543DE82EF95) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """Slot of each index below ``count``: a bijection on ``range(count)``."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def feistel(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, r) & mask)
        return left << shift | right

    out = feistel(np.asarray(index).astype(np.uint64))
    while (outside := out >= np.uint64(count)).any():  # cycle-walking
        out[outside] = feistel(out[outside])
    return out.astype(np.int64)


def _sequences(path: str, length: int, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        width = np.dtype(id_type).itemsize
        step, waiting = length * width, b""

        def rows(chunks: list[bytes], first: int) -> pa.RecordBatch:
            used = [len(c) // width for c in chunks]
            pad = np.array([PAD], id_type).tobytes()
            chunks = [c + pad * (length - n) for c, n in zip(chunks, used)]
            return pa.record_batch(
                [pa.array([part] * len(chunks), pa.int32()), pa.array(range(first, first + len(chunks)), pa.int64()),
                 pa.array(used, pa.int32()), pa.array(chunks, pa.binary())],
                ["part", "local", "used", "records"],
            )

        mark = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids = np.frombuffer(mark.join([*encoder(path).encode(texts_of(batch.column(0))), b""]), "<u4")
            if len(ids) and int(ids.max()) > np.iinfo(id_type).max:
                raise ValueError(f"id {ids.max()} does not fit {id_type}")
            waiting += ids.astype(id_type).tobytes()
            whole = len(waiting) // step
            if whole:
                yield rows([waiting[k * step : (k + 1) * step] for k in range(whole)], local)
                local, waiting = local + whole, waiting[whole * step :]
        if waiting:
            yield rows([waiting], local)

    return run


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, id_type: str = ID_TYPE) -> DataFrame:
    """``part, local, used, records``: the documents' ids, each closed by the id ``END``, in fixed lengths."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy("tokens", _sequences(path or tokenizer_path(), length, id_type)), SEQUENCES)


def _shards(shard: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def one() -> pa.RecordBatch:
            first = held[0][0]
            row = {
                "shard": first // shard, "first_slot": first, "slots": len(held), "stride": stride,
                "used": [h[1] for h in held], "origin": [h[2] for h in held], "records": b"".join(h[3] for h in held),
            }
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("shard", pa.int64()), ("first_slot", pa.int64()), ("slots", pa.int64()), ("stride", pa.int32()),
                ("used", pa.list_(pa.int32())), ("origin", pa.list_(pa.int64())), ("records", pa.binary()),
            ]))

        for batch in batches:
            for h in zip(*(batch.column(c).to_pylist() for c in ("slot", "used", "origin", "records"))):
                if held and held[0][0] // shard != h[0] // shard:
                    yield one()
                    held = []
                held.append(h)
        if held:
            yield one()

    return run


def write_shards(
    docs: DataFrame, out: str, key: int = KEY, path: str | None = None, length: int = LENGTH, shard: int = SHARD,
    id_type: str = ID_TYPE,
) -> None:
    """Write the ids of ``docs(text)`` to the folder ``out`` in training order.

    A null or empty text is the id ``END`` alone; repeated rows count each; an empty
    table writes no shard. Other columns are not read. Only the last sequence of an
    input partition is padded.
    """
    spark = docs.sparkSession
    staged = scratch_path(spark, "sequences")
    sequences(docs, path, length, id_type).write.option("compression", "zstd").parquet(staged)
    stored = spark.read.schema(SEQUENCES).parquet(staged)
    # One row per input partition.
    counts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = cut_lineage(counts.withColumn("start", F.expr("sum(n) OVER (ORDER BY part) - n")), "sequence-offsets")
    count = offsets.agg(F.sum("n")).first()[0] or 0

    @F.arrow_udf("long")
    def slot(index: pa.Array) -> pa.Array:
        return pa.array(permute(index.to_numpy(zero_copy_only=False), count, key))

    placed = stored.join(offsets, "part").withColumn("origin", F.col("start") + F.col("local"))
    placed = placed.withColumn("slot", slot("origin")).withColumn("shard", F.floor(F.col("slot") / shard))
    stride = length * np.dtype(id_type).itemsize
    # Slots are dense, so ranges of shards are known without a sample of the rows.
    shards = -(-count // shard)
    ranges = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place = F.floor(F.col("shard") * ranges / max(1, shards)).cast("int")
    dealt = placed.select("shard", "slot", "used", "origin", "records").repartitionById(ranges, place)
    dealt.sortWithinPartitions("slot").mapInArrow(_shards(shard, stride), SHARDS).write.option(
        "compression", "zstd"
    ).parquet(out)


def read_slots(spark: SparkSession, out: str, first: int = 0, shard: int = SHARD) -> DataFrame:
    """``slot, shard, byte_offset, origin, n_tokens, ids`` from slot ``first`` on.

    Earlier shards are passed over by the files' statistics.
    """
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                skip = max(0, first - r["first_slot"])
                at = range(skip, r["slots"])
                width = r["stride"]
                if not len(at):
                    continue
                records = r["records"]
                yield pa.record_batch(
                    [
                        pa.array([r["first_slot"] + k for k in at], pa.int64()),
                        pa.array([r["shard"]] * len(at), pa.int64()),
                        pa.array([k * width for k in at], pa.int64()),
                        pa.array(r["origin"][skip:], pa.int64()),
                        pa.array(r["used"][skip:], pa.int32()),
                        pa.array([records[k * width : (k + 1) * width] for k in at], pa.binary()),
                    ],
                    ["slot", "shard", "byte_offset", "origin", "n_tokens", "ids"],
                )

    shards = spark.read.schema(SHARDS).parquet(out).where(F.col("shard") >= first // shard)
    return shards.mapInArrow(
        run, "slot long, shard long, byte_offset long, origin long, n_tokens int, ids binary"
    )


