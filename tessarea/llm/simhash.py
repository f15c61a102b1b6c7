"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Two fingerprints that differ in at most ``RADIUS`` = 4 bits agree in two of six
blocks of bits, so every such pair meets under one of 15 block keys. Under a key
the fingerprints are compared exactly, tile against tile, with exclusive-or and
bit counts. A key with many fingerprints is cut into tiles in the order of the
population count; tile pairs whose counts differ by more than the radius are not
formed. A tile pair returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cells, cut_lineage, prepare, scratch_path, text_bytes, tidy
from .components import components
from .exact_dedup import _order as preference

WORDS = 4
SEED = 42
RADIUS = 4
# Bits of the six blocks; six minus the radius of them agree for a linked pair.
BLOCKS = (11, 11, 11, 11, 10, 10)
TILE = 4096

# A byte's bits, each in a byte lane of its own.
_SPREAD = np.array([sum(1 << (8 * b) for b in range(8) if v >> b & 1) for v in range(256)], np.uint64)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    tokens = text.lower().split()  # for bytes both are ASCII only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])),
        np.uint64,
        len(tokens) - words + 1,
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255 * 64):
        lanes = _SPREAD[hashes[k : k + 255 * 64].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [fingerprint(shingle_hashes(t)) for t in text_bytes(batch.column(0))]
        yield pa.record_batch([pa.array(marks, pa.int64()), *batch.columns[1:]], ["mark", *batch.schema.names[1:]])


def fingerprints(docs: DataFrame, *locator: Column) -> DataFrame:
    """``mark, doc_id``: one fingerprint per row of ``docs(doc_id, text)``, with the columns of its ``locator``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *locator)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(tidy("simhash", _fingerprints), f"mark long, {kept}")


def _bands(mark: Column) -> Column:
    """The block keys of a fingerprint: pair of blocks, then their bits."""
    blocks, low = [], 0
    for width in BLOCKS:
        blocks.append(F.shiftright(mark, low).bitwiseAND(F.lit((1 << width) - 1)))
        low += width
    pairs = combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)
    return F.array(
        *[
            F.lit(n << 22).cast("long").bitwiseOR(F.shiftleft(blocks[i], 11)).bitwiseOR(blocks[j])
            for n, (i, j) in enumerate(pairs)
        ]
    )


def _tiled(banded: DataFrame, tile: int) -> DataFrame:
    """``band, t1, t2, side, ones, mark``: the rows of every tile pair.

    A band of up to ``tile`` fingerprints is one tile. Larger ones are cut along
    the population count; the layout comes from counts per band and population
    count, which have at most 65 rows a band.
    """
    sizes = cut_lineage(
        banded.groupBy("band", "ones").agg(F.count(F.lit(1)).alias("n")),
        "band-sizes",
    )
    crowded = sizes.groupBy("band").agg(F.sum("n").alias("all")).where(F.col("all") > tile).select("band")
    layout = cut_lineage(
        sizes.join(crowded, "band").withColumn(
            "low", F.expr("coalesce(sum(n) OVER (PARTITION BY band ORDER BY ones ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
        ),
        "tile-layout",
    )
    tiles = (
        layout.select(
            "band", "ones",
            F.explode(F.expr(f"sequence(low div {tile}, (low + n) div {tile})")).alias("t"),
        )
        .groupBy("band", "t")
        .agg(F.min("ones").alias("least"), F.max("ones").alias("most"))
    )
    tiles = cut_lineage(tiles, "tiles")
    left, right = tiles.alias("l"), tiles.alias("r")
    pairs = left.join(
        right,
        (F.col("l.band") == F.col("r.band"))
        & (F.col("l.t") <= F.col("r.t"))
        & (F.col("r.least") - F.col("l.most") <= RADIUS),
    ).select(F.col("l.band").alias("band"), F.col("l.t").alias("t1"), F.col("r.t").alias("t2"))
    seats = cut_lineage(
        pairs.select("band", "t1", "t2", F.col("t1").alias("t"), F.lit(0).alias("side")).unionAll(
            pairs.where("t1 < t2").select("band", "t1", "t2", F.col("t2").alias("t"), F.lit(1).alias("side"))
        ),
        "tile-pairs",
    )
    share = F.pmod(F.xxhash64("mark"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    placed = banded.join(layout, ["band", "ones"], "left").withColumn(
        "t", F.floor((F.col("low") + share * F.col("n")) / tile).cast("long")
    )
    one = placed.where("t IS NULL").selectExpr("band", "0L AS t1", "0L AS t2", "0 AS side", "ones", "mark")
    many = placed.where("t IS NOT NULL").join(seats, ["band", "t"]).select("band", "t1", "t2", "side", "ones", "mark")
    return one.unionAll(many)


def tile_forest(marks: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between the fingerprints of one tile pair.

    Rows of side 0 meet those of side 1; if there is one side, its rows meet
    each other. Works through the comparison matrix in blocks of rows.
    """
    n, bits = len(marks), marks.view(np.uint64)  # bits of signed numbers are not counted as such
    label = np.arange(n)
    rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(columns)
    columns = rows if alone else columns
    for k in range(0, len(rows), 256):
        i = rows[k : k + 256]
        j = columns[k + 1 :] if alone else columns
        if not len(j):
            break
        near = np.bitwise_count(bits[i][:, None] ^ bits[j][None, :]) <= RADIUS
        near &= label[i][:, None] != label[j][None, :]
        a, b = np.nonzero(near)
        a, b = i[a], j[b]
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
    moved = np.flatnonzero(label != np.arange(n))
    return marks[moved], marks[label[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in cells(batches, ["band", "t1", "t2"]):
        band, t1, t2, side = (found.column(c).to_numpy() for c in ("band", "t1", "t2", "side"))
        marks = found.column("mark").to_numpy()
        bits = marks.view(np.uint64)
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(band)))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat((sizes <= 16) & (t1[starts] == t2[starts]), sizes)
        left, right = [], []
        for shift in range(1, 16):  # small groups all at once
            ok = small[:-shift] & (group[:-shift] == group[shift:])
            if not ok.any():
                break
            i = np.flatnonzero(ok)
            i = i[np.bitwise_count(bits[i] ^ bits[i + shift]) <= RADIUS]
            left.append(marks[i])
            right.append(marks[i + shift])
        for g in np.flatnonzero(~((sizes <= 16) & (t1[starts] == t2[starts]))):
            s = slice(starts[g], starts[g] + sizes[g])
            a, b = tile_forest(marks[s], side[s])
            left.append(a)
            right.append(b)
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        if len(a):
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(marks: DataFrame, tile: int = TILE) -> DataFrame:
    """``a, b``: links of distinct fingerprints ``marks(mark)`` that keep its components.

    Hash partitions of tile pairs, each sorted; a task holds one tile pair.
    """
    banded = marks.select("mark", F.bit_count("mark").alias("ones"), F.explode(_bands(F.col("mark"))).alias("band"))
    tiled = _tiled(banded, tile)
    return (
        tiled.repartition("band", "t1", "t2")
        .sortWithinPartitions("band", "t1", "t2", "ones", "mark")
        .mapInArrow(tidy("simhash", _links), "a long, b long")
    )


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Texts are lower-cased in A-Z, words are runs of other than ASCII white space,
    shingles have four words. A text of fewer words is one shingle; a null text
    or one without words has fingerprint zero and is linked like any other.
    ``component_id`` is the smallest ``doc_id`` reachable through fingerprints
    that differ in at most four bits; null ids are passed over, and a component
    of null ids only has a null one. Repeated rows each have a row. An empty
    table gives no rows. Other columns are not read.
    """
    marks = cut_lineage(fingerprints(docs), "simhash")
    named = _named(marks, F.min("doc_id"), tile).withColumnRenamed("least", "component_id")
    return marks.join(named, "mark").select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id"
    )


def _named(marks: DataFrame, least: Column, tile: int = TILE) -> DataFrame:
    """``mark, least``: every distinct fingerprint with the minimum ``least`` of its whole component."""
    distinct = cut_lineage(marks.groupBy("mark").agg(least.alias("least")), "marks")
    roots = components(links(distinct.select("mark"), tile))
    member = cut_lineage(
        distinct.join(roots, distinct["mark"] == roots["node"], "left").select(
            "mark", "least", F.coalesce("root", "mark").alias("root")
        ),
        "roots",
    )
    firsts = member.groupBy("root").agg(F.min("least").alias("least"))
    return cut_lineage(member.drop("least").join(firsts, "root").select("mark", "least"), "components")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each component, with all columns.

    It is the row with the smallest ``doc_id``, of equal ids the first locator
    (file and row number); one with a null id only if nothing names its
    component. Ids need not be unique: rows are dropped by their locator. The
    rows are first stored in the shared folder, which gives them one.
    """
    path = scratch_path(docs.sparkSession, "simhash-input")
    docs.write.parquet(path)
    stored = docs.sparkSession.read.schema(docs.schema).parquet(path)
    file, row = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    marks = cut_lineage(fingerprints(stored, file, row), "simhash")
    named = _named(marks, F.min(preference()))
    stays = (F.col("file") == F.col("least.file")) & (F.col("row") == F.col("least.row"))
    gone = cut_lineage(
        marks.join(named, "mark").where(~stays).select(F.col("file").alias("__file"), F.col("row").alias("__row")), "dropped"
    )
    at = stored.select("*", file.alias("__file"), row.alias("__row"))
    return at.join(gone, ["__file", "__row"], "left_anti").drop("__file", "__row")
