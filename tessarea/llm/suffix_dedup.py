"""Removal of long repeated byte strings by difference-cover suffix sorting.

A string of 200 bytes that occurs twice selects, by its content alone, the same
anchor in both places: the least hash among its substrings of 100 bytes. Starts
that select one anchor form a run, whose bytes are its context. This spreads the
suffixes over buckets, so that equal prefixes always meet:

1. Runs meet by anchor. Runs with equal contexts are repeats as they stand; an
   anchor with one context only has no others. Both need no sorting.
2. The remaining contexts are sorted in buckets of anchors by the difference-cover
   algorithm: triples at positions not divisible by three are sorted and named,
   the string of names is ranked by recursion, and the remaining suffixes are
   merged in. Letters are eight bytes wide, so three levels reach 200 bytes.
3. Adjacent suffixes are compared over 200 bytes; equal ones are repeats.

An anchor with very many contexts is divided further by the two ends of each
string, which equal strings have in common. Recursing once over the names of the
whole corpus instead would move every suffix through each level's shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, cut_lineage, gathered, prepare, scratch_path, text_bytes

LENGTH = 200
GRAM = 100
LETTER = 8
# Bytes of contexts sorted at once.
CHUNK = 1 << 20
# Contexts of an anchor from which on it is divided by the ends of its strings.
CROWD = 2048
END_BYTES = 40
# Bytes of texts whose anchors are found at once.
BLOCK = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, first start, length of the context and anchor of every run of starts."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < LENGTH:
        return empty
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    at = np.arange(n - GRAM + 1)
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(at)])
    # The least gram of each window; of equal ones the leftmost, which content decides too.
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    window, have = LENGTH - GRAM + 1, 1
    while have * 2 <= window:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < window:
        least = np.minimum(least[: len(least) - (window - have)], least[window - have :])
    begin = np.concatenate([[0], np.cumsum(size)])
    change = np.zeros(n + 1, np.int64)
    long_ = size >= LENGTH
    np.add.at(change, begin[:-1][long_], 1)
    np.add.at(change, begin[:-1][long_] + size[long_] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(change)[: len(least)] > 0)
    if not len(start):
        return empty
    chosen = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    text = np.searchsorted(begin, start[first], side="right") - 1
    return text, start[first] - begin[text], start[last] + LENGTH - start[first], gram[chosen[first]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes]]]:
    """Rows in blocks of a bounded number of bytes, or one row."""
    files, rows, texts, held = [], [], [], 0
    for batch in batches:
        for f, r, t in zip(batch.column("file").to_pylist(), batch.column("row").to_pylist(), text_bytes(batch.column("text"))):
            if held and held + len(t) > BLOCK:
                yield files, rows, texts
                files, rows, texts, held = [], [], [], 0
            files.append(f)
            rows.append(r)
            texts.append(t)
            held += len(t)
    if texts:
        yield files, rows, texts


RUNS = "file long, row long, start long, size long, anchor long, context long, check long, copies int"


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with two hashes of their contexts.

    Contexts that a block holds more than once are repeats already: one goes to
    its anchor, ``copies`` two or more; the others have ``copies`` zero.
    """
    for files, rows, texts in _blocks(batches):
        text, start, size, anchor = runs(texts)
        if not len(text):
            continue
        pair = np.empty((len(text), 2), np.int64)
        for i, (t, a, n) in enumerate(zip(text.tolist(), start.tolist(), size.tolist())):
            d = xxhash.xxh3_128_digest(texts[t][a : a + n])
            pair[i] = np.frombuffer(d, np.int64)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (pair[order[1:]] != pair[order[:-1]]).any(axis=1)
        copies = np.zeros(len(text), np.int32)
        copies[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
        files, rows = np.array(files, np.int64), np.array(rows, np.int64)
        yield pa.record_batch(
            [pa.array(c) for c in (files[text], rows[text], start, size, anchor.view(np.int64), pair[:, 0], pair[:, 1], copies)],
            ["file", "row", "start", "size", "anchor", "context", "check", "copies"],
        )


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are repeats (``whole``) or must be sorted (``open``); the rest is dropped.

    Rows come sorted by anchor and context. Holds a batch and the rows of one
    anchor in it; what an anchor needs to know of earlier batches is carried on.
    """
    for found in cells(batches, ["anchor", "context", "check"]):
        anchor, context, check, copies = (
            found.column(c).to_numpy() for c in ("anchor", "context", "check", "copies")
        )
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]) | (check[1:] != check[:-1])
        group = np.cumsum(new) - 1
        whole = (np.bincount(group, weights=np.maximum(copies, 1)) > 1)[group] | (copies == 0)
        yield pa.record_batch(
            [
                *(found.column(c).combine_chunks() for c in ("file", "row", "start", "size", "anchor")),
                pa.array(whole),
                pa.array(new & (copies > 0)),
            ],
            ["file", "row", "start", "size", "anchor", "whole", "first"],
        )


SIFTED = "file long, row long, start long, size long, anchor long, whole boolean, first boolean"


def ranks(letters: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``reach`` letters or more; the rank counts smaller ones.

    ``letters`` are positive numbers below 2**21.
    """
    n = len(letters)
    s = np.zeros(n + 3, np.uint64)
    s[:n] = letters
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    a, b = np.uint64(21), np.uint64(42)
    triples = s[sample] << b | s[sample + 1] << a | s[sample + 2]
    _, name = np.unique(triples, return_inverse=True)
    name = name.astype(np.uint64) + np.uint64(1)
    if reach > 3 and len(sample) and int(name.max()) < len(sample):
        string = np.concatenate([name[: len(one)], [np.uint64(0)], name[len(one) :]])
        order = ranks(string, -(-reach // 3))
        name = np.concatenate([order[: len(one)], order[len(one) + 1 :]])
        name = name.astype(np.uint64) + np.uint64(1)
    rank = np.zeros(n + 3, np.uint64)
    rank[sample] = name
    rest = np.arange(0, n, 3)

    def pair(i: np.ndarray) -> np.ndarray:
        return s[i] << a | rank[i + 1]

    def triple(i: np.ndarray) -> np.ndarray:
        return s[i] << b | s[i + 1] << a | rank[i + 2]

    # How many suffixes are smaller: of each class, in a form that both sides have.
    out = np.zeros(n, np.int64)
    rest_pair, rest_triple = pair(rest), triple(rest)
    one_pair, two_triple = pair(one), triple(two)
    sorted_pair, sorted_triple = np.sort(rest_pair), np.sort(rest_triple)
    by_pair, by_triple, by_name = np.sort(one_pair), np.sort(two_triple), np.sort(name)
    out[rest] = (
        np.searchsorted(sorted_pair, rest_pair)
        + np.searchsorted(by_pair, rest_pair)
        + np.searchsorted(by_triple, rest_triple)
    )
    out[one] = np.searchsorted(by_name, rank[one]) + np.searchsorted(sorted_pair, one_pair)
    out[two] = np.searchsorted(by_name, rank[two]) + np.searchsorted(sorted_triple, two_triple)
    return out


def repeated_starts(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context number and start of every 200-byte string that occurs elsewhere in ``contexts``."""
    size = np.array([len(c) for c in contexts], np.int64)
    data = b"".join(contexts) + b"\0" * (LETTER * 4)
    n = int(size.sum())
    # The eight bytes from each position as one number, in byte order.
    flat = np.frombuffer(data, np.uint8)
    eight = np.zeros(n, np.uint64)
    for k in range(LETTER):
        eight = eight << np.uint64(8) | flat[k : k + n].astype(np.uint64)
    _, letter = np.unique(eight, return_inverse=True)
    # Positions in the order of strings of letters: every eighth position follows.
    order = np.concatenate([np.arange(p, n, LETTER) for p in range(LETTER)])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    if n >= 1 << 21:
        raise ValueError("too many bytes for one chunk")
    rank = ranks(letter[order] + 1, -(-LENGTH // LETTER))
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    many = size - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), many)
    start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    at = begin[owner] + start
    sort = np.argsort(rank[place[at]], kind="stable")
    x, y = at[sort[:-1]], at[sort[1:]]
    same = np.ones(len(x), bool)
    for k in range(0, LENGTH, LETTER):
        i = np.flatnonzero(same)
        same[i] = eight[x[i] + k] == eight[y[i] + k]
    twice = np.zeros(len(at), bool)
    twice[sort[:-1][same]] = True
    twice[sort[1:][same]] = True
    return owner[twice], start[twice]


CONTEXTS = "anchor long, part long, file long, row long, start long, bytes binary"
SPANS = "file long, row long, start long, size long"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each open run; of crowded anchors each string by itself, with a part from its ends."""
    for batch in batches:
        rows: list[tuple] = []
        for f, r, text, found in zip(
            batch.column("file").to_pylist(), batch.column("row").to_pylist(), text_bytes(batch.column("text")),
            batch.column("found").to_pylist(),
        ):
            for run in found:
                a, n = run["start"], run["size"]
                if not run["crowded"]:
                    rows.append((run["anchor"], 0, f, r, a, text[a : a + n]))
                    continue
                for s in range(a, a + n - LENGTH + 1):
                    string = text[s : s + LENGTH]
                    ends = xxhash.xxh64_intdigest(string[:END_BYTES] + string[-END_BYTES:]) >> 1
                    rows.append((run["anchor"], ends | 1, f, r, s, string))
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int64()] * 5 + [pa.binary()]
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "part", "file", "row", "start", "bytes"]
        )


def _collapsed(batches: Iterator[pa.RecordBatch], spans: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without repeats of the row before; all rows of a repeated context are added to ``spans``.

    Rows come sorted by anchor, part and bytes. The strings of a crowded anchor end
    here: each is a context of its own.
    """
    before: pa.RecordBatch | None = None
    for batch in gathered(batches, 32_768):
        both = batch if before is None else pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
        anchor, part = both.column("anchor").to_numpy(), both.column("part").to_numpy()
        data = both.column("bytes").to_numpy(zero_copy_only=False)
        same = np.zeros(len(anchor), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (part[1:] == part[:-1]) & (data[1:] == data[:-1])
        twice = same.copy()
        twice[:-1] |= same[1:]
        if twice.any():
            taken = both.filter(pa.array(twice))
            size = pa.compute.binary_length(taken.column("bytes")).cast(pa.int64())
            spans.append(
                pa.record_batch([taken.column("file"), taken.column("row"), taken.column("start"), size], ["file", "row", "start", "size"])
            )
        fresh = ~same & (part == 0)
        if before is not None:
            fresh[0] = False
        yield both.filter(pa.array(fresh))
        before = both.slice(both.num_rows - 1)


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sort whole buckets in chunks of bounded size; spans of bytes to remove."""

    def solve(found: pa.Table) -> pa.RecordBatch:
        contexts = found.column("bytes").to_pylist()
        owner, start = repeated_starts(contexts)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(owner))[: len(first)] - 1
        file, row, begin = (found.column(c).to_numpy() for c in ("file", "row", "start"))
        o = owner[first]
        return pa.record_batch(
            [pa.array(v, pa.int64()) for v in (file[o], row[o], begin[o] + start[first], start[last] - start[first] + LENGTH)],
            ["file", "row", "start", "size"],
        )

    spans: list[pa.RecordBatch] = []
    waiting: list[pa.Table] = []
    held = 0
    for found in cells(_collapsed(batches, spans), ["anchor"]):
        yield from spans
        spans.clear()
        anchor = found.column("anchor").to_numpy()
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        edges = np.append(np.flatnonzero(new), len(anchor))
        weight = np.concatenate([[0], np.cumsum(pa.compute.binary_length(found.column("bytes")).to_numpy())])[edges]
        k = 0
        while k < len(edges) - 1:
            # As many buckets as fit, one at least.
            j = int(np.searchsorted(weight, weight[k] + CHUNK - held, side="right")) - 1
            if j <= k and waiting:
                yield solve(pa.concat_tables(waiting))
                waiting, held = [], 0
                continue
            j = max(j, k + 1)
            waiting.append(found.slice(edges[k], edges[j] - edges[k]))
            held += int(weight[j] - weight[k])
            k = j
    yield from spans
    if waiting:
        yield solve(pa.concat_tables(waiting))


def removal_spans(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, start, size`` of bytes to remove from the texts at ``path``; spans may overlap."""
    texts = _located(spark, path).select("file", "row", "text")
    found = texts.where("octet_length(text) >= " + str(LENGTH)).mapInArrow(_find_runs, RUNS)
    # Copies that a block has already settled need no anchor and are dealt at random.
    dealt = found.repartition(F.when(F.col("copies") > 0, F.col("anchor")).otherwise(F.xxhash64("file", "row", "start")))
    sifted = dealt.sortWithinPartitions("anchor", "context", "check", F.desc("copies")).mapInArrow(_settle, SIFTED)
    stored = cut_lineage(sifted, "suffix-runs")
    crowds = cut_lineage(
        stored.where("first").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select(
            "anchor", F.lit(True).alias("crowded")
        ),
        "suffix-crowds",
    )
    open_ = stored.where("first").join(crowds, "anchor", "left").groupBy("file", "row").agg(
        F.collect_list(
            F.struct("anchor", "start", "size", F.coalesce("crowded", F.lit(False)).alias("crowded"))
        ).alias("found")
    )
    contexts = texts.join(open_, ["file", "row"]).select("file", "row", "text", "found").mapInArrow(_cut_contexts, CONTEXTS)
    sorted_ = (
        contexts.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "bytes").mapInArrow(_sorted_spans, SPANS)
    )
    return stored.where("whole").select("file", "row", "start", "size").unionByName(sorted_)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sifted runs without those of anchors that have one context and no copies.

    A first run is kept as ``first`` only where its anchor has another context. The
    last one waits for the next; nothing else is held.
    """
    waiting: pa.RecordBatch | None = None
    before: int | None = None  # anchor of the first run before the waiting one

    def decided(firsts: pa.RecordBatch, count: int) -> pa.RecordBatch:
        anchor = firsts.column("anchor").to_numpy()
        shared = np.zeros(len(anchor), bool)
        shared[1:] = anchor[1:] == anchor[:-1]
        shared[:-1] |= shared[1:]
        shared[0] |= before is not None and anchor[0] == before
        whole = firsts.column("whole").to_numpy(zero_copy_only=False)
        out = pa.record_batch([*firsts.columns[:-1], pa.array(shared)], firsts.schema.names).slice(0, count)
        return out.filter(pa.array((shared | whole)[:count]))

    for batch in _sift(batches):
        first = batch.column("first").to_numpy(zero_copy_only=False)
        whole = batch.column("whole").to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(whole & ~first))
        firsts = batch.filter(pa.array(first))
        if waiting is not None:
            firsts = pa.Table.from_batches([waiting, firsts]).combine_chunks().to_batches()[0]
        if firsts.num_rows:
            yield decided(firsts, firsts.num_rows - 1)
            if firsts.num_rows > 1:
                before = firsts.column("anchor")[firsts.num_rows - 2].as_py()
            waiting = firsts.slice(firsts.num_rows - 1)
    if waiting is not None:
        yield decided(waiting, 1)


def _located(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text, file, row``: the locator is a hash of the file's path and the row's number in it."""
    return spark.read.parquet(path).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(
            batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), batch.column("spans").to_pylist()
        ):
            kept, end, removed, count = [], 0, 0, 0
            open_ = None
            for s in sorted(spans or (), key=lambda s: s["start"]):
                a, b = s["start"], s["start"] + s["size"]
                if open_ is None or a > open_[1]:
                    if open_ is not None:
                        kept.append(text[end : open_[0]])
                        end, removed, count = open_[1], removed + open_[1] - open_[0], count + 1
                    open_ = [a, b]
                else:
                    open_[1] = max(open_[1], b)
            if open_ is not None:
                kept.append(text[end : open_[0]])
                end, removed, count = open_[1], removed + open_[1] - open_[0], count + 1
            kept.append(text[end:])
            out.append((doc_id, len(text), removed, count, b"".join(kept)))
        columns = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64()] * 4 + [pa.binary()]
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def remove_repeats(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of the Parquet table ``path(doc_id, text)``.

    Removes each byte of a text that lies in a string of 200 bytes which also starts
    anywhere else, in the same text too; a null text is empty. ``kept`` holds the
    remaining bytes, ``n_spans`` the number of maximal removed runs. Rows with null
    or repeated identifiers count each. An empty table gives no rows. Other columns
    are not read.
    """
    prepare(spark)
    spans = removal_spans(spark, path).groupBy("file", "row").agg(
        F.collect_list(F.struct("start", "size")).alias("spans")
    )
    return _located(spark, path).join(spans, ["file", "row"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, CUT)


def remove_repeats_of(docs: DataFrame) -> DataFrame:
    """:func:`remove_repeats` of a frame, stored in the shared folder first."""
    path = scratch_path(docs.sparkSession, "suffix-input")
    docs.select("doc_id", "text").write.parquet(path)
    return remove_repeats(docs.sparkSession, path)
