"""Prefix trie of conversations, with count-min screening of prefix digests.

A node is a distinct sequence of first turns; its key is its depth and a 128-bit
digest, the exclusive-or of one hash per position, so that digests are running totals
and no task needs a whole conversation. A count-min sketch of all digests never
estimates too low: an estimate of one proves that no other conversation has the
prefix. Such nodes, the tails, are emitted where they are found. Only prefixes that
are possibly shared go through a shuffle, where they are grouped exactly.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import cut_lineage, prepare

# A conversation c starts with up to crc32(c) % HEADS turns of conversation c - c % GROUP.
GROUP, HEADS = 100, 6
# Counters of the sketch per prefix, their least and greatest number, and those of one row.
SPARE, LEAST, MOST, CHUNK = 4, 2**10, 2**24, 2**14
# Groups in which the tasks' sketches are added up first.
FIRST_SUMS = 64
NODE = ["d", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _running(totals: Sequence[tuple[str, bool]], keep: Sequence[str]):
    """Running totals per ``conv_id`` within a sorted partition; (column, whether exclusive-or)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lengths = np.diff(np.append(starts, len(keys)))
            columns = [batch.column(c) for c in keep]
            for name, xor in totals:
                values = batch.column(name).to_numpy().astype(np.int64)
                op, undo = (np.bitwise_xor, np.bitwise_xor) if xor else (np.add, np.subtract)
                sofar = op.accumulate(values)
                sofar = undo(sofar, np.repeat(undo(sofar[starts], values[starts]), lengths))
                if last is not None and keys[0] == last:
                    sofar[: lengths[0]] = op(sofar[: lengths[0]], carried[name])
                carried[name] = sofar[-1]
                columns.append(pa.array(sofar))
            last = keys[-1]
            columns.append(pa.array(np.full(len(keys), part, np.int32)))
            yield pa.record_batch(columns, [*keep, *(f"run_{name}" for name, _ in totals), "part"])

    return run


def running(
    df: DataFrame, order: Sequence[str], keep: Sequence[str], sums: Sequence[str] = (), xors: Sequence[str] = ()
) -> DataFrame:
    """``keep`` and the running totals ``run_<column>`` per ``conv_id``, own row included, by ``order``.

    Rows are dealt by ranges of (conv_id, order), so a conversation of any length is
    spread over tasks. What a partition's first conversation had before is added from
    totals of those conversations that span partitions: two rows per partition at most.
    """
    spark = df.sparkSession
    totals = [*((c, False) for c in sums), *((c, True) for c in xors)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = list(dict.fromkeys(["conv_id", *order, *keep, *sums, *xors]))
    dealt = df.select(*needed).repartitionByRange(parts, "conv_id", *order).sortWithinPartitions("conv_id", *order)
    kept = list(dict.fromkeys([*keep, *sums, *xors]))
    fields = [next(f for f in dealt.schema.fields if f.name == c) for c in kept]
    fields += [StructField(f"run_{c}", LongType()) for c, _ in totals]
    schema = StructType([*fields, StructField("part", IntegerType())])
    stored = cut_lineage(dealt.mapInArrow(_running(totals, kept), schema), "running")
    spans = stored.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).collect()
    seen = Counter(k for r in spans for k in {r.lo, r.hi})
    cut = [(k,) for k, n in seen.items() if n > 1]
    if not cut:
        return stored.drop("part")
    own = [(F.bit_xor if xor else F.sum)(c).alias(c) for c, xor in totals]
    rows = stored.join(F.broadcast(spark.createDataFrame(cut, "conv_id long")), "conv_id").groupBy("conv_id", "part").agg(*own)
    before: dict[int, list[int]] = defaultdict(lambda: [0] * len(totals))
    offsets = []
    for r in sorted(rows.collect(), key=lambda r: r.part):
        offsets.append((r.conv_id, r.part, *before[r.conv_id]))
        before[r.conv_id] = [b ^ r[c] if xor else b + r[c] for b, (c, xor) in zip(before[r.conv_id], totals)]
    names = ", ".join(f"off_{c} long" for c, _ in totals)
    told = F.broadcast(spark.createDataFrame(offsets, f"conv_id long, part int, {names}"))
    joined = stored.join(told, ["conv_id", "part"], "left")

    def whole(c: str, xor: bool) -> Column:
        offset = F.coalesce(f"off_{c}", F.lit(0))
        return F.col(f"run_{c}").bitwiseXOR(offset) if xor else F.col(f"run_{c}") + offset

    return joined.select(*kept, *[whole(c, xor).alias(f"run_{c}") for c, xor in totals])


def rebuilt(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, ``conv_id, d, length, chars, c1, c2``, and the conversations.

    ``c1, c2`` are the digest of role and text, ``length`` the number of turns of the
    conversation, ``chars`` code points of the text.
    """
    rows = talks.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),  # deals out rows that are equal in all else
        F.lit(1).cast("long").alias("pos"),
    )
    rows = rows.withColumns(
        {
            "c1": F.xxhash64(F.lit(1), "role", "text"),
            "c2": F.xxhash64(F.lit(2), "text", "role"),
            "chars": F.length("text").cast("long"),
        }
    )
    listed = running(rows, ["turn", "role", "text", "tie"], ["conv_id", "c1", "c2", "chars"], sums=["pos"]).select(
        "conv_id", "c1", "c2", "chars", F.col("run_pos").alias("pos")
    )
    own = listed.groupBy("conv_id").agg(F.max("pos").alias("own"))
    heads = (
        listed.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "c1", "c2", "chars"))).alias("turns"))  # HEADS - 1 at most
    )
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = (
        own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), taken.alias("taken"))
        .join(heads, "base", "left")
        .withColumn("head", F.expr("coalesce(slice(turns, 1, cast(taken as int)), array())"))
        .withColumn("shift", F.size("head").cast("long") - F.col("taken"))
        .withColumn("length", F.size("head") + F.greatest(F.col("own") - F.col("taken"), F.lit(0)))
        .select("conv_id", "taken", "shift", "length", "head")
    )
    convs = cut_lineage(convs, "convs")
    first = convs.select("conv_id", "length", F.inline("head")).withColumnRenamed("pos", "d")
    rest = (
        listed.join(convs.drop("head"), "conv_id")
        .where("pos > taken")
        .select("conv_id", "length", (F.col("pos") + F.col("shift")).alias("d"), "c1", "c2", "chars")
    )
    return first.select(*rest.columns).unionByName(rest), convs.select("conv_id", "length")


def _sketch(width: int):
    """A task's counters, each 0, 1 or 2 for more, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((2, width), np.uint8)
        for batch in batches:
            for row, name in enumerate(("k1", "k2")):
                at, n = np.unique(batch.column(name).to_numpy() & (width - 1), return_counts=True)
                counters[row, at] = np.minimum(2, counters[row, at] + np.minimum(n, 2).astype(np.uint8))
        part = TaskContext.get().partitionId() % FIRST_SUMS
        squeeze = zstandard.ZstdCompressor(level=1).compress
        chunks = counters.reshape(-1, min(CHUNK, width))
        used = np.flatnonzero(chunks.any(axis=1))
        yield pa.record_batch(
            [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array([squeeze(chunks[k].tobytes()) for k in used], pa.binary())],
            ["part", "chunk", "data"],
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    """One chunk of counters from many."""
    expand = zstandard.ZstdDecompressor().decompress
    total = 0
    for data in table.column("data"):
        total = np.minimum(2, total + np.frombuffer(expand(data.as_py()), np.uint8))
    packed = zstandard.ZstdCompressor(level=1).compress(total.astype(np.uint8).tobytes())
    return pa.table([table.column("part")[:1], table.column("chunk")[:1], pa.array([packed], pa.binary())], ["part", "chunk", "data"])


def sketch(prefixes: DataFrame) -> np.ndarray:
    """Two rows of counters of all digests; at most ``MOST`` each, whatever the input."""
    wanted, width = SPARE * prefixes.count(), LEAST
    while width < min(wanted, MOST):
        width *= 2
    schema = "part int, chunk int, data binary"
    parts = prefixes.select("k1", "k2").mapInArrow(_sketch(width), schema)
    some = parts.groupBy("part", "chunk").applyInArrow(_added, schema)
    whole = some.groupBy("chunk").applyInArrow(_added, schema)
    size = min(CHUNK, width)
    counters = np.zeros((2 * width // size, size), np.uint8)
    expand = zstandard.ZstdDecompressor().decompress
    for r in whole.collect():
        counters[r.chunk] = np.frombuffer(expand(bytes(r.data)), np.uint8)
    return counters.reshape(2, width)


def _screen(counters):
    """Adds ``kind``: 0 a tail whose parent is a tail or the root, 1 another tail, 2 possibly shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counters.value
        mask = table.shape[1] - 1
        for batch in batches:
            names = batch.schema.names

            def alone(a: str, b: str) -> np.ndarray:
                first, second = (batch.column(c).to_numpy() & mask for c in (a, b))
                return np.minimum(table[0, first], table[1, second]) == 1

            own = alone("k1", "k2")
            above = alone("p1", "p2") | (batch.column("d").to_numpy() == 1)
            kind = np.where(own, np.where(above, 0, 1), 2).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(kind)], [*names, "kind"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, read in order: no list of them is ever held."""
    key, digest, done = None, None, []

    def taken() -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[]] * 4
        done.clear()
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], [*NODE, "ends_sha256"])

    for batch in batches:
        for d, k1, k2, conv_id in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
            if (d, k1, k2) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (d, k1, k2), hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
        yield taken()
    if key is not None:
        done.append((*key, digest.hexdigest()))
    yield taken()


def nodes(talks: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations; the columns are those of ``COLUMNS``.

    ``talks`` has ``conv_id, turn, role, text``. Turns are taken by ``turn`` (null
    first), then role, then text; a null role or text counts as empty, repeated rows
    each count, rows without conversation take no part. Texts of any length are only
    hashed. An empty table gives no rows. Other columns are not read. The ids that end
    at one node are hashed in order by one task, as a digest of a sequence must be.
    """
    spark = prepare(talks.sparkSession)
    turns, convs = rebuilt(talks)
    one = turns.withColumns(
        {"t1": F.xxhash64(F.lit(3), "d", "c1", "c2"), "t2": F.xxhash64(F.lit(4), "d", "c2", "c1")}
    )
    prefixes = running(one, ["d"], ["conv_id", "d", "length", "chars"], xors=["t1", "t2"]).select(
        "conv_id", "d", "length", "chars", F.col("run_t1").alias("k1"), F.col("run_t2").alias("k2"),
        F.col("run_t1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("run_t2").bitwiseXOR(F.col("t2")).alias("p2"),
    )
    counters = spark.sparkContext.broadcast(sketch(prefixes))
    screened = cut_lineage(
        prefixes.mapInArrow(_screen(counters), StructType([*prefixes.schema.fields, StructField("kind", IntegerType())])),
        "screened",
    )
    everyone = convs.agg(
        F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("length") > 0).alias("speaking")
    ).first()

    # Exact groups of what may be shared.
    maybe = screened.where("kind = 2")
    groups = maybe.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"), F.max("chars").alias("chars"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    groups = cut_lineage(groups.where("n > 1"), "groups")
    parent_of = groups.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("above"))
    joined = cut_lineage(maybe.join(groups.select(*NODE, "owner"), NODE, "left"), "maybe")
    shared = joined.where("owner IS NOT NULL")
    tails = screened.where("kind = 1").unionByName(joined.where("owner IS NULL").drop("owner"))
    tails = cut_lineage(tails.join(parent_of, ["d", "p1", "p2"], "left"), "tails")

    # Children: nodes and first tails, by the key of what they hang on.
    hanging = groups.where("d > 1").select(F.col("d") - 1, "p1", "p2").union(
        tails.where("above IS NOT NULL").select(F.col("d") - 1, "p1", "p2")
    )
    children = hanging.toDF(*NODE).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    whole = groups.join(children, NODE, "left").join(parent_of, ["d", "p1", "p2"], "left")
    whole = whole.withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0)),
            "saving": (F.col("n") - 1) * F.col("chars"),
        }
    ).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    whole = cut_lineage(whole, "nodes")

    # What lies below: a node's own part is put on its owner's path, and each member
    # of a node hands it all that its path has from there on.
    path = shared.select("conv_id", *NODE, "length").join(
        whole.select(F.col("owner").alias("conv_id"), "d", "saving", "leaf"), ["conv_id", "d"], "left"
    )
    path = path.fillna(0, ["saving", "leaf"])
    sums = running(path, ["d"], ["conv_id", *NODE, "length"], sums=["saving", "leaf"])
    sums = cut_lineage(sums, "path")
    totals = sums.groupBy("conv_id").agg(
        F.sum("saving").alias("all_saving"), F.sum("leaf").alias("all_leaf"), F.max("d").alias("deepest")
    )
    totals = cut_lineage(totals, "totals")
    below = (
        sums.join(totals, "conv_id")
        .groupBy(*NODE)
        .agg(
            F.sum(F.col("all_saving") - F.col("run_saving") + F.col("saving")).alias("saved_tokens"),
            F.sum(
                F.col("all_leaf") - F.col("run_leaf") + F.col("leaf") + (F.col("length") > F.col("deepest")).cast("long")
            ).alias("n_leaves"),
        )
    )
    ending = shared.where("d = length").select(*NODE, "conv_id")
    silent = convs.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id")
    ends = (
        ending.unionByName(silent)
        .repartition(*NODE)
        .sortWithinPartitions(*NODE, "conv_id")
        .mapInArrow(_ends, "d long, k1 long, k2 long, ends_sha256 string")
    )
    ends = cut_lineage(ends, "ends")

    root = F.lit(everyone.first)
    known = whole.join(below, NODE).join(ends.where("d > 0"), NODE, "left")
    inner = known.select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.coalesce("above", root).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )

    def tail(rows: DataFrame, above: Column) -> DataFrame:
        last = F.col("d") == F.col("length")
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        return rows.select(
            "conv_id", F.col("d").alias("depth"), above.alias("parent_conv_id"), one.alias("n_convs"),
            F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
        )

    before = F.when(F.col("d") == 1, root).otherwise(F.col("conv_id"))
    out = tail(screened.where("kind = 0"), before).unionByName(tail(tails, F.coalesce("above", before))).unionByName(inner)
    if not everyone.n:
        return out
    inside = whole.agg(
        F.coalesce(F.sum("saving"), F.lit(0)).alias("saving"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"),
        F.count_if(F.col("d") == 1).alias("children"),
    ).first()
    alone = screened.where("kind = 0 AND d = 1").count() + tails.where("d = 1").count()
    with_tail = everyone.speaking - ending.count()
    said = ends.where("d = 0").select("ends_sha256").first()
    top = (
        everyone.first, 0, None, everyone.n, inside.children + alone,
        max(1, inside.leaves + with_tail), inside.saving, said.ends_sha256 if said else EMPTY,
    )
    kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS)
    return out.unionByName(spark.createDataFrame([top], kinds))
