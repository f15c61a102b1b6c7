"""Nearest neighbours by inner product: inverted lists with adaptive dimension scan.

Vectors get one more component so that the largest inner product is the smallest
distance, and are turned by a random rotation. Lists come from centroids of a
bounded sample; every vector is in the list of its nearest centroid. A query first
scans its own list in full, which bounds its radius. In the other probed lists the
rotated vectors are read in blocks of columns, and a candidate is abandoned when a
hypothesis test on its partial distance says that it lies outside the radius.
Survivors are scored exactly, in double precision on the original vectors.

Equal vectors are one candidate that carries its smallest ids, as many as a result
can hold; a vector that a third of all rows share is one row of one list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, prepare

NEAREST = 20
EVERY = 20
# Vectors that the centroids are fitted on, and most lists.
SAMPLE, LISTS = 16_384, 1024
# Share of the lists that a query probes, and its least number.
PROBED, LEAST_PROBED = 0.75, 8
COLUMNS = 16
# Width of the hypothesis test: larger abandons later.
EPSILON = 2.1
# Candidates and queries of one cell of work.
CHUNK = 4096
SEED = 3

CELL = "quid long, cand_id long, score double"


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: finite vectors that are not null or zero, of the commonest dimension."""
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad & some)
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # no negative zero
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes.n if sizes else 0))


def rotation(dimension: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component that makes all candidates equally long."""
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's algorithm on the sample, from a seeded choice of rows."""
    rnd = np.random.default_rng(SEED)
    centre = x[rnd.permutation(len(x))[:lists]].copy()
    for _ in range(8):
        near = nearest_lists(x, centre, 1)[:, 0]
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def nearest_lists(x: np.ndarray, centre: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the nearest centroids, nearest first."""
    distance = (centre**2).sum(axis=1)[None, :] - 2 * (x @ centre.T)
    if count == 1:
        return distance.argmin(axis=1)[:, None]
    count = min(count, len(centre))
    part = np.argpartition(distance, count - 1, axis=1)[:, :count]
    order = np.take_along_axis(distance, part, axis=1).argsort(axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def _route(centre: np.ndarray, longest: float, probes: int, dimension: int, is_query: bool):
    """Lists of each row of ``(uid, v)``: one of a candidate, ``probes`` of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), dimension)
            x = np.hstack([x, np.zeros((len(x), 1))]) if is_query else lifted(x, longest)
            near = nearest_lists(x, centre, probes)
            row = np.repeat(np.arange(len(x)), near.shape[1])
            taken = batch.take(pa.array(row))
            step = np.tile(np.arange(near.shape[1]), len(x))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(near.ravel(), pa.int64()), pa.array(step, pa.int64())],
                [*taken.schema.names, "list", "step"],
            )

    return run


def scan(
    x: np.ndarray, turned: np.ndarray, query: np.ndarray, turned_query: np.ndarray, radius: float
) -> np.ndarray:
    """Rows of ``x`` that survive the column blocks; ``radius`` is a squared distance."""
    alive = np.arange(len(x))
    partial = np.zeros(len(x))
    width = turned.shape[1]
    for k in range(0, width, COLUMNS):
        part = turned[alive, k : k + COLUMNS] - turned_query[k : k + COLUMNS]
        partial = partial + np.einsum("ij,ij->i", part, part)
        seen = min(width, k + COLUMNS)
        bound = radius * (1 + 1e-9) if seen == width else radius * seen / width * (1 + EPSILON / math.sqrt(seen)) ** 2
        stays = partial <= bound + 1e-12
        alive, partial = alive[stays], partial[stays]
    return alive


def _cell(longest: float, dimension: int, nearest: int):
    """Best candidates of the queries of a cell, as rows of ids."""
    turn = rotation(dimension + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            x, q = matrix(left.column("v"), dimension), matrix(right.column("v"), dimension)
            ids = left.column("ids").to_pylist()
            turned = lifted(x, longest) @ turn
            turned_q = np.hstack([q, np.zeros((len(q), 1))]) @ turn
            floor = right.column("floor").to_pylist()
            for i, quid in enumerate(right.column("uid").to_pylist()):
                if floor[i] is None:
                    alive = np.arange(len(x))
                else:
                    radius = float(q[i] @ q[i]) + longest**2 - 2 * floor[i]
                    alive = scan(x, turned, q[i], turned_q[i], max(radius, 0.0))
                score = np.einsum("ij,j->i", x[alive], q[i])
                best = []
                for s, c in sorted(zip((-score).tolist(), alive.tolist()), key=lambda p: (p[0], ids[p[1]][0]))[: nearest + 1]:
                    best.extend((s, v) for v in ids[c])
                out.extend((quid, v, -s) for s, v in sorted(best)[: nearest + 1])
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            ["quid", "cand_id", "score"],
        )

    return run


def _scored(candidates: DataFrame, queries: DataFrame, longest: float, dimension: int, nearest: int) -> DataFrame:
    """Cells of one list: chunks of its candidates against chunks of its queries."""
    sizes = cut_lineage(
        candidates.groupBy("list").agg(F.count(F.lit(1)).alias("nc"))
        .join(queries.groupBy("list").agg(F.count(F.lit(1)).alias("nq")), "list")
        .select("list", F.ceil(F.col("nc") / CHUNK).alias("cs"), F.ceil(F.col("nq") / CHUNK).alias("qs")),
        "ann-sizes",
    )

    def dealt(rows: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        return rows.join(sizes, "list").withColumns(
            {mine: F.pmod(F.xxhash64("uid"), F.col(own)), theirs: F.explode(F.expr(f"sequence(0L, {other} - 1)"))}
        )

    left = dealt(candidates, "cs", "qs", "c", "q").select("list", "c", "q", "uid", "v", "ids")
    right = dealt(queries, "qs", "cs", "q", "c").select("list", "c", "q", "uid", "v", "floor")
    keys = ["list", "c", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_cell(longest, dimension, nearest), CELL)


def _top(rows: DataFrame, key: str, count: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "cand_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def search(
    vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", every: int = EVERY, nearest: int = NEAREST,
    probed: float = PROBED, lists: int = LISTS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of every row whose id is divisible by ``every``.

    Nearest first, ties to the smaller id; a query is no candidate of its own. Rows
    with null ids and unusable vectors (see :func:`usable`) take no part, nor do
    repeats of the same row. An empty table gives no rows. Other columns are not
    read. The radius of the first list and the share ``probed`` make the result
    approximate; scores are exact.
    """
    spark = prepare(vectors.sparkSession)
    rows = cut_lineage(usable(vectors, ident, vector).distinct(), "ann-rows")
    shape = rows.agg(
        F.max(F.size("v")).alias("d"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not shape.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, longest = shape.d, math.sqrt(shape.longest)
    first = Window.partitionBy("v").orderBy("id")
    distinct = cut_lineage(
        rows.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= nearest + 1)
        .groupBy("v")
        .agg(F.min("id").alias("uid"), F.sort_array(F.collect_list("id")).alias("ids")),
        "ann-distinct",
    )
    taught = distinct.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").toArrow()
    x = lifted(matrix(taught.column("v"), dimension), longest)
    count = max(1, min(lists, int(math.sqrt(shape.n) / 3), len(x)))
    centre = centroids(x, count)
    probes = min(count, max(LEAST_PROBED, math.ceil(probed * count)))
    placed = cut_lineage(
        distinct.select("uid", "v", "ids").mapInArrow(
            _route(centre, longest, 1, dimension, False),
            "uid long, v array<double>, ids array<long>, list long, step long",
        ),
        "ann-lists",
    )
    asked = cut_lineage(
        rows.where(F.col("id") % every == 0).join(distinct.select("v", "uid"), "v").select("id", "uid"), "ann-queries"
    )
    queries = distinct.join(asked.select("uid").distinct(), "uid").select("uid", "v")
    routed = cut_lineage(
        queries.mapInArrow(
            _route(centre, longest, probes, dimension, True), "uid long, v array<double>, list long, step long"
        ),
        "ann-probes",
    )
    own = routed.where("step = 0").withColumn("floor", F.lit(None).cast("double"))
    near = cut_lineage(_scored(placed, own, longest, dimension, nearest), "ann-own")
    # The last of a full result bounds what can still enter it.
    floors = near.groupBy("quid").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = floors.select(F.col("quid").alias("uid"), F.when(F.col("n") > nearest, F.col("floor")).alias("floor"))
    others = routed.where("step > 0").join(cut_lineage(floors, "ann-floors"), "uid", "left")
    more = _scored(placed, others, longest, dimension, nearest)
    best = cut_lineage(_top(near.unionByName(more), "quid", nearest + 1).drop("rank"), "ann-best")
    answers = asked.select(F.col("id").alias("query_id"), F.col("uid").alias("quid")).join(best, "quid")
    ranked = _top(answers.where("cand_id <> query_id"), "query_id", nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("cand_id").alias("vec_id"), "score")
