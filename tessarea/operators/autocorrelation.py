"""Moran's I with binary symmetric weights, for one graph or many at once.

Edges count only between areas that have a value: an edge to an area without one
is left out of the degrees as well as of the sum. Islands: the mean and the sum of
squares run over all areas, while ``n`` counts only areas that have neighbours
(``adjust_n``, the usual zero-policy rule).

With ``by`` (e.g. level and variant) values and edges carry these columns, and
every combination is tested by itself, all in one job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normal_upper_tail, ratio
from ..session import cut_lineage, ship
from .graph import edges_between

# The leading bits of the key by which areas are numbered split them into
# 2**BUCKET_BITS buckets, so that no task sorts a whole graph.
BUCKET_BITS = 12
# The key is the number in the first 15 hex digits of the hash: 60 bits.
KEY_DIGITS = 15
# Fewest permutations of a unit of work on a large graph, about how many edges its part of
# the graph has, and how many units a slot of the cluster gets.
BLOCK, PART_EDGES, UNITS_PER_SLOT = 16, 1_000_000, 4
# Values or edges that travel in one row, and that are permuted at once (they stay in cache).
PIECE, AT_ONCE = 2048, 65_536
# Partners of an area that are met without a lookup of the area itself.
PARTNERS = 8
# Graphs of at most so many areas and edges, all tests together, go to every task.
PACKED = 1_000_000
# Rounds of the keyed bijection (an even number) and hex digits of a round's key.
ROUNDS, ROUND_DIGITS = 8, 7
# Fixed values of the round function: a Mersenne prime and multipliers below 2**17,
# so that no product leaves 63 bits.
PRIME, FACTORS = 2_147_483_647, (40_503, 48_271, 69_621)


def _attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the columns of ``stats``, one row per ``by``, to every row."""
    if by:
        return df.join(stats, list(by))
    return df.withColumn("_s", stats.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")


def _centred(values: DataFrame, by: Sequence[str], area: str, x: str) -> DataFrame:
    means = values.groupBy(*by).agg(F.avg(x).alias("_mean"))
    if by:
        means = cut_lineage(means, "means")  # one row per test
    return _attach(values, means, by).select(
        *by, F.col(area).alias("_area"), (F.col(x).cast("double") - F.col("_mean")).alias("_z")
    )


def _cross_sum(z: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of z_i z_j over directed edges, from each undirected edge once."""
    half = edges.where("src < dst").select(*by, "src", "dst")
    return (
        half.join(z.select(*by, F.col("_area").alias("src"), F.col("_z").alias("_zi")), [*by, "src"])
        .join(z.select(*by, F.col("_area").alias("dst"), F.col("_z").alias("_zj")), [*by, "dst"])
        .groupBy(*by)
        .agg((2.0 * F.sum(F.col("_zi") * F.col("_zj"))).alias("_cross"))
    )


def _beside(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of one row per ``by``; without ``by`` both have one row."""
    if by:
        return df.join(other, list(by), "left")
    return _attach(df, other, by)


def _parts(z: DataFrame, edges: DataFrame, by: Sequence[str], adjust_n: bool) -> DataFrame:
    """One row per ``by``: ``n, _zz, _z4, _s0, _s2, _cross, moran_i``."""
    degrees = edges.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("_d"))
    graph = degrees.groupBy(*by).agg(
        F.sum("_d").cast("double").alias("_s0"),
        (4.0 * F.sum(F.col("_d") * F.col("_d"))).alias("_s2"),
        F.count(F.lit(1)).alias("_linked"),
    )
    moments = z.groupBy(*by).agg(
        F.count("_z").alias("_all"),
        F.sum(F.pow("_z", F.lit(2))).alias("_zz"),
        F.sum(F.pow("_z", F.lit(4))).alias("_z4"),
    )
    joined = _beside(_beside(moments, graph, by), _cross_sum(z, edges, by), by)
    zero = F.lit(0.0)
    return joined.select(
        *by,
        F.coalesce(F.col("_linked" if adjust_n else "_all"), F.lit(0)).cast("double").alias("n"),
        "_zz",
        "_z4",
        F.coalesce("_s0", zero).alias("_s0"),
        F.coalesce("_s2", zero).alias("_s2"),
        F.coalesce("_cross", zero).alias("_cross"),
    ).withColumn("moran_i", ratio(F.col("n") * F.col("_cross"), F.col("_s0") * F.col("_zz")))


def _statistic(
    values: DataFrame, edges: DataFrame, area: str, x: str, adjust_n: bool, by: Sequence[str]
) -> DataFrame:
    z = _centred(values, by, area, x)
    return _parts(z, edges_between(z, edges, "_area", by), by, adjust_n)


def morans_i(
    values: DataFrame,
    edges: DataFrame,
    area: str = "area",
    x: str = "x",
    adjust_n: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row ``by..., n, moran_i``; NULL for a constant measure or a graph without edges.

    ``values`` holds one row per area without missing measures.
    """
    return _statistic(values, edges, area, x, adjust_n, list(by)).select(
        *by, F.col("n").cast("bigint").alias("n"), "moran_i"
    )


def moran_test(
    values: DataFrame,
    edges: DataFrame,
    area: str = "area",
    x: str = "x",
    adjust_n: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Analytic test under randomisation, alternative "greater".

    One row ``by..., moran_i, expectation, variance, z, p_value``.
    """
    n, s0, s2 = F.col("n"), F.col("_s0"), F.col("_s2")
    s1 = 2.0 * s0
    b2 = ratio(n * F.col("_z4"), F.col("_zz") * F.col("_zz"))
    expectation = ratio(F.lit(-1.0), n - 1)
    top = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * (
        (n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0
    )
    second_moment = ratio(top, (n - 1) * (n - 2) * (n - 3) * s0 * s0)
    return (
        _statistic(values, edges, area, x, adjust_n, list(by))
        .withColumn("expectation", expectation)
        .withColumn("variance", second_moment - F.col("expectation") * F.col("expectation"))
        .withColumn(
            "z", ratio(F.col("moran_i") - F.col("expectation"), F.when(F.col("variance") > 0, F.sqrt("variance")))
        )
        .select(
            *by, "moran_i", "expectation", "variance", "z", normal_upper_tail(F.col("z")).alias("p_value")
        )
    )


def _order_key(seed: int) -> Column:
    """What areas are numbered by: the first 60 bits of ``md5(seed|area)``."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_area").cast("string")))
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("bigint")


def _numbers(z: DataFrame, by: Sequence[str], seed: int, bucket_bits: int) -> DataFrame:
    """``by..., _area, _z, _number``: dense numbers from 0 by (key, area), without a task that sees a whole graph."""
    hashed = z.select(*by, "_area", "_z", _order_key(seed).alias("_key")).withColumn(
        "_bucket", F.shiftright("_key", 4 * KEY_DIGITS - bucket_bits)
    )
    sizes = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # At most 2**bucket_bits rows per test.
    offsets = cut_lineage(
        sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")), "offsets"
    )
    within = W.partitionBy(*by, "_bucket").orderBy("_key", "_area")
    return (
        hashed.withColumn("_place", F.row_number().over(within) - 1)
        .join(offsets, [*by, "_bucket"])
        .select(*by, "_area", "_z", (F.col("_offset") + F.col("_place")).alias("_number"))
    )


def _grid(n: Column) -> Column:
    """Struct ``excess, rest, a, b``: the sides of a grid of at least ``n`` cells.

    Of the a from half the root of n up to it (2 at least), the one whose grid ``a * ceil(n / a)``
    has fewest cells too many, and of these the largest.
    """
    root = F.floor(F.sqrt(n))
    sides = F.sequence(F.greatest(F.lit(2), F.floor((root + 1) / 2)), F.greatest(F.lit(2), root))

    def sized(a: Column) -> Column:
        b = F.floor((n + a - 1) / a)
        return F.struct((a * b - n).alias("excess"), (-a).alias("rest"), a.alias("a"), b.alias("b"))

    return F.array_min(F.transform(sides, sized))


def _round_keys(seed: int, sim: int) -> list[int]:
    """The keys of one permutation: the first 28 bits of ``md5(seed|sim|round)``."""
    return [int(hashlib.md5(f"{seed}|{sim}|{k}".encode()).hexdigest()[:ROUND_DIGITS], 16) for k in range(ROUNDS)]


def _remainder(x: np.ndarray, m: int) -> np.ndarray:
    """``x % m``; NumPy divides by one number faster than it takes the remainder."""
    return x - x // np.uint64(m) * np.uint64(m)


def _round_shifts(seed: int, sims: Sequence[int], a: int, b: int) -> Iterator[list[pa.Array]]:
    """Per permutation: by how much each round moves a half, for every value of the other half.

    A round adds a keyed function of one half to the other in turn. Halves are not brought back below
    ``a`` and ``b`` after a round, so a table repeats as often as the half it is looked up by may have grown.
    """
    narrow = np.uint16 if (ROUNDS // 2 + 1) * max(a, b) <= 1 << 16 else np.uint32
    at_once = max(1, AT_ONCE // max(a, b))
    for first in range(0, len(sims), at_once):
        keys = np.array([_round_keys(seed, sim) for sim in sims[first : first + at_once]], np.uint64)
        tables = []
        for k in range(ROUNDS):
            half, side = (b, a) if k % 2 == 0 else (a, b)
            t = np.arange(half, dtype=np.uint64) * np.uint64(FACTORS[0]) + keys[:, k : k + 1]
            t = _remainder(t, PRIME)
            t = _remainder((t ^ (t >> np.uint64(15))) * np.uint64(FACTORS[1]), PRIME)
            t = _remainder((t ^ (t >> np.uint64(13))) * np.uint64(FACTORS[2]), PRIME)
            tables.append(_remainder(t, side).astype(narrow))
        for i in range(len(keys)):
            yield [pa.array(np.tile(table[i], (k + 1) // 2 + 1)) for k, table in enumerate(tables)]


def _taken(values: pa.Array, at: np.ndarray) -> np.ndarray:
    """``values[at]``; Arrow takes narrow positions as they are, NumPy would widen them first."""
    return pc.call_function("take", [values, pa.array(at)], _UNCHECKED).to_numpy(zero_copy_only=False)


_UNCHECKED = pc.TakeOptions(boundscheck=False)


class _Grid:
    """The cells of the a x b grid on which ``n`` numbers are permuted."""

    def __init__(self, n: int, a: int, b: int):
        self.n, self.b, self.full = n, b, a * b == n
        self.narrow = np.uint16 if (ROUNDS // 2 + 1) * max(a, b) <= 1 << 16 else np.uint32
        cell = np.uint32 if a * b <= 1 << 32 else np.uint64
        # Where a row starts and where a column lies, for halves that have grown.
        self.rows = pa.array(np.tile(np.arange(a, dtype=cell) * cell(b), ROUNDS // 2 + 1))
        self.columns = pa.array(np.tile(np.arange(b, dtype=cell), ROUNDS // 2 + 1))

    def halves(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (number // self.b).astype(self.narrow), (number % self.b).astype(self.narrow)

    def _walked(self, left: np.ndarray, right: np.ndarray, shifts: Sequence[pa.Array]) -> np.ndarray:
        """One pass of the rounds."""
        left, right = left.copy(), right.copy()
        for k in range(0, ROUNDS, 2):
            left += _taken(shifts[k], right)
            right += _taken(shifts[k + 1], left)
        return _taken(self.rows, left) + _taken(self.columns, right)

    def permuted(self, left: np.ndarray, right: np.ndarray, shifts: Sequence[pa.Array]) -> np.ndarray:
        """Where a permutation sends the numbers with these halves: a Feistel network on the cells.

        A cell beyond n is walked on along its cycle.
        """
        x = self._walked(left, right, shifts)
        while not self.full and len(beyond := np.flatnonzero(x >= self.n)):
            x[beyond] = self._walked(*self.halves(x[beyond]), shifts)
        return x


def _by_rank(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The ends of edges, their partners' places rank by rank, and the edges that are left as pairs of places.

    Ends with more partners come first, else they keep the order in which the edges name them. So the k-th
    partners belong to the first ends, in their order.
    """
    ends, first, places = np.unique(np.stack([src, dst], 1).ravel(), return_index=True, return_inverse=True)
    places = places.reshape(-1, 2)
    order = np.lexsort((first, -np.bincount(places[:, 0], minlength=len(ends))))
    moved = np.empty(len(ends), np.int64)
    moved[order] = np.arange(len(ends))
    src, dst = moved[places[:, 0]], moved[places[:, 1]]
    sort = np.argsort(src, kind="stable")
    src, dst = src[sort], dst[sort].astype(np.uint32)
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    left = rank >= PARTNERS
    ranks = [dst[rank == k] for k in range(min(PARTNERS, rank.max(initial=-1) + 1))]
    return ends[order], ranks, (src[left].astype(np.uint32), dst[left])


def _cross_sums(
    values: pa.Array, src: np.ndarray, dst: np.ndarray, n: int, a: int, b: int, seed: int, sims: Sequence[int]
) -> list[float | None]:
    """Per permutation: twice the sum over the edges of the products of the permuted values.

    None where an edge meets a missing value. Edges that name near areas one after the other are summed faster.
    """
    missing = pa.array(values.is_null().to_numpy(zero_copy_only=False).view(np.uint8)) if values.null_count else None
    values = pa.array(values.to_numpy(zero_copy_only=False))
    ends, ranks, pairs = _by_rank(src, dst)
    grid = _Grid(n, a, b)
    left, right = grid.halves(ends)
    y = np.empty(len(ends))
    permuted = pa.Array.from_buffers(pa.float64(), len(y), [None, pa.py_buffer(y)])  # the same memory
    out = []
    for shifts in _round_shifts(seed, sims, a, b):
        gap = False
        for k in range(0, len(ends), AT_ONCE):
            at = grid.permuted(left[k : k + AT_ONCE], right[k : k + AT_ONCE], shifts)
            y[k : k + AT_ONCE] = _taken(values, at)
            gap = gap or (missing is not None and bool(_taken(missing, at).any()))  # every end has an edge
        total = 0.0
        for partners in ranks:
            for k in range(0, len(partners), AT_ONCE):
                z = _taken(permuted, partners[k : k + AT_ONCE])
                total += float(y[k : k + len(z)] @ z)
        for k in range(0, len(pairs[0]), AT_ONCE):
            total += float(_taken(permuted, pairs[0][k : k + AT_ONCE]) @ _taken(permuted, pairs[1][k : k + AT_ONCE]))
        out.append(None if gap else 2.0 * total)
    return out


def _packed_crosses(z: DataFrame, half: DataFrame, by: Sequence[str], nsim: int, seed: int) -> DataFrame:
    """``by..., _sim, _permuted`` of graphs that fit into a task, without a shuffle of values.

    A test's values, in the order of their numbers, and its edges, as pairs of
    numbers, are one row. It is joined to every block of permutations, which then
    permutes the values and sums the products along the edges by itself.
    """
    key = list(by) or ["_one"]
    one = F.lit(1).alias("_one")
    values = z.select(*by, one, "_area", "_z").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(_order_key(seed).alias("k"), "_area", "_z"))).alias("_values")
    )
    values = cut_lineage(values, "numbered")
    numbers = values.select(*key, F.posexplode("_values").alias("_number", "_v")).select(
        *key, F.col("_number"), F.col("_v._area").alias("_area")
    )
    edges = half.select(*by, one, "src", "dst")
    for end in ("src", "dst"):
        named = numbers.select(*key, F.col("_area").alias(end), F.col("_number").alias(f"_{end}"))
        edges = edges.join(named, [*key, end])
    # In the order of the areas: near ones lie together.
    pairs = edges.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "_src", "_dst"))).alias("_pairs"))
    n = F.size("_values").cast("bigint")
    graphs = cut_lineage(
        values.join(pairs, key).select(
            *key,
            F.transform("_values", lambda v: v["_z"]).alias("_values"),
            F.transform("_pairs", lambda e: e["_src"].cast("bigint")).alias("_src"),
            F.transform("_pairs", lambda e: e["_dst"].cast("bigint")).alias("_dst"),
            n.alias("_n"),
            _grid(n).alias("_grid"),
        ),
        "graphs",
    )
    spread = graphs.sparkSession.sparkContext.defaultParallelism * 4
    width = -(-nsim // spread)
    sims = graphs.select(*key, F.explode(F.sequence(F.lit(1), F.lit(nsim), F.lit(width))).alias("_first")).repartition(spread)
    work = sims.join(F.broadcast(graphs), key).select(
        F.struct(*key).alias("_test"), "_first", "_values", "_src", "_dst", "_n", F.col("_grid.a").alias("_a"), F.col("_grid.b").alias("_b")
    )
    ship(z.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                arrays = [row["_values"].values, *(row[c].values.to_numpy() for c in ("_src", "_dst"))]
                first = row["_first"].as_py()
                at = range(first, min(first + width, nsim + 1))
                sums = _cross_sums(*arrays, *(row[c].as_py() for c in ("_n", "_a", "_b")), seed, at)
                test = pa.repeat(row["_test"], len(at))
                yield pa.record_batch([test, pa.array(at, pa.int32()), pa.array(sums, pa.float64())], ["_test", "_sim", "_permuted"])

    test = work.select("_test").schema.fields[0].dataType.simpleString()
    found = work.mapInArrow(run, f"_test {test}, _sim int, _permuted double")
    return found.select(*[F.col("_test")[c].alias(c) for c in by], "_sim", "_permuted")


def _streamed_crosses(
    z: DataFrame, half: DataFrame, by: Sequence[str], nsim: int, seed: int, block: int, bucket_bits: int
) -> DataFrame:
    """The same for large graphs: no task holds more than the values and a part of the edges.

    A unit of work is a part of a graph's edges, near in the order of the areas, and a range of
    permutations. The values, in the order of their numbers, and the edges of its part are sent
    to it in small rows, sorted, by one shuffle; the units of a graph follow from the slots of the
    cluster, so that this shuffle grows with the graph and not with ``nsim``. Its sums are added up.
    """
    spark = z.sparkSession
    numbered = cut_lineage(_numbers(z, by, seed, bucket_bits), "numbered")
    edges = half
    for end in ("src", "dst"):
        edges = edges.join(numbered.select(*by, F.col("_area").alias(end), F.col("_number").alias(f"_{end}")), [*by, end])
    total = half.count()
    # A row's place in its partition: the edges of a part stay in the order of the areas.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    edges = edges.repartitionByRange(total // PART_EDGES + 1, *by, "src", "dst").sortWithinPartitions(*by, "src", "dst")
    edges = edges.select(*by, "_src", "_dst", F.spark_partition_id().alias("_part"), place.alias("_place"))
    edges = cut_lineage(edges, "numbered-edges")

    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_grid", _grid(F.col("_n")))
    sizes = cut_lineage(sizes, "sizes")
    # Units of about equal work: a part with few edges takes more permutations at once.
    work = nsim * total / (spark.sparkContext.defaultParallelism * UNITS_PER_SLOT)
    width = F.least(F.lit(nsim), F.greatest(F.lit(block), F.ceil(F.lit(work) / F.count(F.lit(1))))).cast("int")
    shares = edges.groupBy(*by, "_part").agg(width.alias("_width"))
    units = _attach(shares, sizes, by).withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(nsim), F.col("_width"))))
    # One row per unit: a few for each slot of the cluster, or one for each test.
    units = cut_lineage(
        units.withColumn("_unit", F.row_number().over(W.orderBy(*by, "_part", "_first")) - 1), "units"
    )
    count = units.count()

    pieces = numbered.groupBy(*by, F.floor(F.col("_number") / PIECE).alias("_piece")).agg(
        F.array_sort(F.collect_list(F.struct("_number", "_z"))).alias("_packed")
    )
    nothing = F.array().cast("array<bigint>")
    values = pieces.select(
        *by, "_piece", F.transform("_packed", lambda p: p["_z"]).alias("_values"), nothing.alias("_src"), nothing.alias("_dst")
    )
    bundle = F.floor(F.col("_place") / PIECE) - F.lit(1 << 33)  # before all values
    packed = edges.groupBy(*by, "_part", bundle.alias("_piece")).agg(
        F.array_sort(F.collect_list(F.struct("_place", "_src", "_dst"))).alias("_pairs")
    )
    pairs = packed.select(
        *by,
        "_part",
        "_piece",
        F.array().cast("array<double>").alias("_values"),
        F.transform("_pairs", lambda e: e["_src"]).alias("_src"),
        F.transform("_pairs", lambda e: e["_dst"]).alias("_dst"),
    )
    plan = units.select(*by, "_part", "_unit", "_first", "_width", "_n", F.col("_grid.a").alias("_a"), F.col("_grid.b").alias("_b"))
    to_all = values.join(F.broadcast(plan), list(by)) if by else values.crossJoin(F.broadcast(plan))
    sent = to_all.drop("_part").unionByName(pairs.join(F.broadcast(plan), [*by, "_part"]).drop("_part"))
    columns = ["_unit", "_first", "_width", "_n", "_a", "_b", "_piece", "_values", "_src", "_dst"]
    dealt = sent.select(*columns).repartitionById(max(1, count), F.col("_unit").cast("int")).sortWithinPartitions("_unit", "_piece")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {"_values": [], "_src": [], "_dst": []}

        def summed() -> pa.RecordBatch:
            number, first, width, n, a, b = unit
            arrays = [pa.array(np.concatenate(held["_values"])), *(np.concatenate(held[c]) for c in ("_src", "_dst"))]
            at = range(first, min(first + width, nsim + 1))
            sums = _cross_sums(*arrays, n, a, b, seed, at)
            return pa.record_batch(
                [pa.array([number] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(sums, pa.float64())],
                ["_unit", "_sim", "_permuted"],
            )

        for batch in batches:
            numbers = batch.column("_unit").to_numpy()
            starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else []
            for lo, hi in zip(starts, [*starts[1:], len(numbers)]):
                rows = batch.slice(lo, hi - lo)
                if unit is not None and unit[0] != numbers[lo]:
                    yield summed()
                    held = {c: [] for c in held}
                unit = tuple(rows.column(c)[0].as_py() for c in ("_unit", "_first", "_width", "_n", "_a", "_b"))
                for c in held:  # products with a missing value do not count
                    held[c].append(rows.column(c).flatten().fill_null(0).to_numpy().copy())
        if unit is not None:
            yield summed()

    found = dealt.mapInArrow(run, "_unit int, _sim int, _permuted double")
    return found.join(F.broadcast(units.select(*by, "_unit")), "_unit").groupBy(*by, "_sim").agg(F.sum("_permuted").alias("_permuted"))


def moran_mc(
    values: DataFrame,
    edges: DataFrame,
    nsim: int,
    seed: int = 1,
    area: str = "area",
    x: str = "x",
    adjust_n: bool = True,
    by: Sequence[str] = (),
    block: int = BLOCK,
    bucket_bits: int = BUCKET_BITS,
    packed: int = PACKED,
) -> DataFrame:
    """Permutation test: one row ``by..., moran_i, nsim, n_at_least, p_value``.

    ``p = (#{permuted I >= observed I} + 1) / (nsim + 1)``. A permutation is a keyed
    bijection of the areas' numbers, so nothing is sorted or ranked per permutation;
    it follows from ``seed`` alone and does not depend on partitioning. Tests of at
    most ``packed`` areas and edges together are copied to every task; of larger ones
    a task gets the values and a part of the edges. Both give the same numbers.
    """
    by = list(by)
    z = cut_lineage(_centred(values, by, area, x), "centred")
    linked = cut_lineage(edges_between(z, edges, "_area", by), "value-edges")
    half = linked.where("src < dst").select(*by, "src", "dst")
    if z.count() + half.count() <= packed:
        crosses = _packed_crosses(z, half, by, nsim, seed)
    else:
        crosses = _streamed_crosses(z, half, by, nsim, seed, block, bucket_bits)
    observed = cut_lineage(
        _parts(z, linked, by, adjust_n).select(*by, "moran_i", "_cross", "_zz"), "observed"
    )
    # Sums of the same numbers in another order differ in the last bits only.
    reached: Column = F.col("_permuted") >= F.col("_cross") - 1e-10 * F.col("_zz")
    counted = _attach(crosses, observed, by).groupBy(*by).agg(F.count_if(reached).alias("_n"))
    known = F.col("moran_i").isNotNull()
    return _beside(observed, counted, by).select(
        *by,
        "moran_i",
        F.lit(nsim).alias("nsim"),
        F.when(known, F.col("_n")).alias("n_at_least"),
        F.when(known, (F.col("_n") + 1) / F.lit(nsim + 1.0)).alias("p_value"),
    )
