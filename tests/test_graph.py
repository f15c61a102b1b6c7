"""Contiguity and Moran's I against brute force."""

import hashlib
import math
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessarea.operators import autocorrelation as ac
from tessarea.operators import graph as g
from tessarea.operators.frame import drop_missing

RINGS = "k long, rings array<array<struct<x:double,y:double>>>"


def square(x, y, side=1.0):
    c = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return [[(float(a), float(b)) for a, b in c]]


def brute(shapes, shared):
    points = {k: {p for ring in rings for p in ring} for k, rings in shapes.items()}
    return sorted(
        (a, b) for a, b in itertools.permutations(points, 2) if len(points[a] & points[b]) >= shared
    )


@pytest.fixture
def shapes():
    """A grid, a corner contact, a pair sharing two single points, a multipart area, an island."""
    cells = {10 * r + c: square(c, r) for r in range(3) for c in range(3)}
    cells[100] = square(3, 3)
    cells[101] = [[(3.0, 0.0), (5.0, 1.0), (4.0, 0.5), (3.0, 1.0), (3.0, 0.0)]]
    cells[102] = square(20, 20) + square(3, 2)
    cells[103] = square(50, 50)
    return cells


@pytest.mark.parametrize("queen", [False, True])
@pytest.mark.parametrize("hot_point", [256, 2, 1, 0])
def test_contiguity(spark, rows, shapes, queen, hot_point):
    """Treating nearly every point as shared by too many gives the same edges."""
    layer = spark.createDataFrame(list(shapes.items()), RINGS)
    edges = g.contiguity(layer, "k", queen=queen, hot_point=hot_point)
    assert rows(edges, "src", "dst") == brute(shapes, 1 if queen else 2)


def test_many_areas_at_one_point(spark, rows):
    """Wedges around one point: all touch it, few share an edge."""
    n = 60
    angle = 2 * np.pi * np.arange(n) / n
    rim = [(round(float(np.cos(a)), 9), round(float(np.sin(a)), 9)) for a in angle]
    wedges = {i: [[(0.0, 0.0), rim[i], rim[(i + 1) % n], (0.0, 0.0)]] for i in range(n)}
    layer = spark.createDataFrame(list(wedges.items()), RINGS)
    edges = g.contiguity(layer, "k", hot_point=5)
    assert rows(edges, "src", "dst") == brute(wedges, 2)
    assert edges.count() == 2 * n


def test_layers_stay_apart(spark, rows):
    layer = spark.createDataFrame(
        [("a", 1, square(0, 0)), ("a", 2, square(1, 0)), ("b", 3, square(1, 0))],
        "level string, " + RINGS,
    )
    edges = g.contiguity(layer, "k", by=["level"])
    assert rows(edges, "level", "src", "dst") == [("a", 1, 2), ("a", 2, 1)]


def test_degree_and_islands(spark, rows, shapes):
    layer = spark.createDataFrame(list(shapes.items()), RINGS)
    edges = g.contiguity(layer, "k")
    want = {k: sum(a == k for a, _ in brute(shapes, 2)) for k in shapes}
    assert dict(rows(g.degree(layer, edges, "k"))) == want
    lonely = sorted(k for k, n in want.items() if n == 0)
    assert [k for (k,) in rows(g.islands(layer, edges, "k"), "k")] == lonely
    kept = [k for (k,) in rows(g.drop_islands(layer, edges, "k"), "k")]
    assert kept == sorted(set(shapes) - set(lonely))
    assert {r.w for r in g.weights(edges).collect()} == {1.0}


def test_vertices_keep_ring_order(spark, rows):
    layer = spark.createDataFrame([(1, square(0, 0) + square(5, 5))], RINGS)
    v = rows(g.vertices(layer, "k"))
    assert v[1] == (1, 0, 1, 1.0, 0.0) and v[5] == (1, 1, 0, 5.0, 5.0) and len(v) == 10


def moran_parts(x, edges, islands=True):
    keys = sorted(x)
    at = {k: i for i, k in enumerate(keys)}
    w = np.zeros((len(keys), len(keys)))
    for a, b in edges:
        w[at[a], at[b]] = 1
    z = np.array([x[k] for k in keys]) - np.mean(list(x.values()))
    n = int((w.sum(1) > 0).sum())
    return w, z, n


@pytest.fixture
def measured(spark, shapes):
    rng = np.random.default_rng(5)
    x = {k: float(v) for k, v in zip(shapes, rng.poisson(5, len(shapes)))}
    edges = brute(shapes, 2)
    return (
        x,
        edges,
        spark.createDataFrame(list(x.items()), "area long, x double"),
        spark.createDataFrame(edges, "src long, dst long"),
    )


def test_morans_i(measured):
    x, edges, values, graph = measured
    w, z, n = moran_parts(x, edges)
    want = n / w.sum() * (z @ w @ z) / (z @ z)
    got = ac.morans_i(values, graph).first()
    assert got.n == n and got.moran_i == pytest.approx(want)
    full = ac.morans_i(values, graph, adjust_n=False).first()
    assert full.n == len(x) and full.moran_i == pytest.approx(want * len(x) / n)


def test_moran_test_moments(measured):
    """Expectation and variance against the textbook sums over the weight matrix."""
    x, edges, values, graph = measured
    w, z, n = moran_parts(x, edges)
    s0, s1 = w.sum(), ((w + w.T) ** 2).sum() / 2
    s2 = ((w.sum(0) + w.sum(1)) ** 2).sum()
    b2 = n * (z**4).sum() / (z @ z) ** 2
    e = -1 / (n - 1)
    var = (
        n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2)
        - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)
    ) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - e * e
    got = ac.moran_test(values, graph).first()
    assert got.expectation == pytest.approx(e) and got.variance == pytest.approx(var)
    assert got.z == pytest.approx((got.moran_i - e) / var**0.5)
    assert 0 < got.p_value < 1


def test_constant_measure_has_no_moran(spark, measured):
    _, _, values, graph = measured
    flat = values.withColumn("x", F.lit(2.0))
    assert ac.morans_i(flat, graph).first().moran_i is None
    assert ac.moran_test(flat, graph).first().p_value is None
    mc = ac.moran_mc(flat, graph, 9).first()
    assert mc.moran_i is None and mc.p_value is None


def test_graph_without_edges(spark, measured):
    _, _, values, graph = measured
    assert ac.moran_mc(values, graph.where("src < 0"), 9).first().p_value is None


def plain_bijection(n, seed, sim):
    """The permutation of 0..n-1 in plain Python."""
    root = math.isqrt(n)
    a = min(range(max(2, (root + 1) // 2), max(2, root) + 1), key=lambda s: (s * -(-n // s) - n, -s))
    b = -(-n // a)
    keys = [int(hashlib.md5(f"{seed}|{sim}|{k}".encode()).hexdigest()[:7], 16) for k in range(ac.ROUNDS)]

    def mixed(half, key):
        t = (half * 40503 + key) % 2147483647
        t = ((t ^ (t >> 15)) * 48271) % 2147483647
        return ((t ^ (t >> 13)) * 69621) % 2147483647

    def walk(x):
        left, right = divmod(x, b)
        for k in range(ac.ROUNDS):
            if k % 2 == 0:
                left = (left + mixed(right, keys[k])) % a
            else:
                right = (right + mixed(left, keys[k])) % b
        return left * b + right

    out = []
    for x in range(n):
        x = walk(x)
        while x >= n:
            x = walk(x)
        out.append(x)
    return out


def test_bijections_are_permutations_and_look_random():
    """Every area gets each value alike often, and neighbours in number do not stay together."""
    for n in (1, 2, 3, 5, 7, 23, 30, 93, 125):
        seen, together = np.zeros((n, n)), 0
        for sim in range(1, 401):
            p = plain_bijection(n, 1, sim)
            assert sorted(p) == list(range(n))
            seen[range(n), p] += 1
            together += np.count_nonzero(np.abs(np.diff(p)) == 1)
        if n >= 5:
            expected, df = 400 / n, (n - 1) ** 2
            assert ((seen - expected) ** 2 / expected).sum() / df == pytest.approx(1, abs=4 * math.sqrt(2 / df))
            assert together / 400 == pytest.approx(2 * (n - 1) / n, abs=0.3)


def sides(n):
    a = min(range(max(2, (math.isqrt(n) + 1) // 2), max(2, math.isqrt(n)) + 1), key=lambda s: (s * -(-n // s) - n, -s))
    return a, -(-n // a)


@pytest.mark.parametrize("n", [2, 23, 1_009])
@pytest.mark.parametrize("gaps", [(), (5,)])
def test_sums_along_edges_against_plain_bijections(n, gaps):
    """A hub, repeated edges and loops, a grid with cells too many, and missing values."""
    rng = np.random.default_rng(n)
    x = [None if k in gaps else float(v) for k, v in enumerate(rng.normal(size=n))]
    src = np.r_[rng.integers(0, n, 3 * n), np.zeros(40, int), [1, 1]]
    dst = np.r_[rng.integers(0, n, 3 * n), rng.integers(0, n, 40), [0, 0]]
    found = ac._cross_sums(pa.array(x, pa.float64()), src, dst, n, *sides(n), 3, range(2, 9))
    for sim, got in zip(range(2, 9), found, strict=True):
        p = np.array(plain_bijection(n, 3, sim))
        met = [(x[i], x[j]) for i, j in zip(p[src], p[dst])]
        want = None if any(None in pair for pair in met) else 2 * sum(u * v for u, v in met)
        assert got == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-9))


def test_rounds_are_computed_for_the_sides_of_the_grid(monkeypatch):
    """The keyed function of a round costs the root of the areas, not each of them."""
    n, computed, remainder = 40_000, [], ac._remainder
    monkeypatch.setattr(ac, "_remainder", lambda x, m: computed.append(x.size) or remainder(x, m))
    ends = np.arange(n - 1)
    values = pa.array(np.random.default_rng(2).normal(size=n))
    assert len(ac._cross_sums(values, ends, ends + 1, n, *sides(n), 1, range(1, 4))) == 3
    assert sum(computed) <= 3 * ac.ROUNDS * 4 * max(sides(n))


@pytest.mark.parametrize("packed, block, bits", [(1_000_000, 256, 12), (0, 256, 12), (0, 7, 2)])
def test_moran_mc_against_brute_force(measured, packed, block, bits):
    """Both ways, of small and of large graphs, give the numbers of plain Python."""
    x, edges, values, graph = measured
    w, z, n = moran_parts(x, edges)
    keys = sorted(x)
    nsim, seed = 199, 4
    value = dict(zip(keys, z))
    numbered = sorted(keys, key=lambda k: (int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:15], 16), k))
    observed = z @ w @ z
    at_least = 0
    for s in range(1, nsim + 1):
        moved = {k: value[numbered[to]] for k, to in zip(numbered, plain_bijection(len(keys), seed, s))}
        p = np.array([moved[k] for k in keys])
        at_least += p @ w @ p >= observed - 1e-10 * (z @ z)
    for parts in (1, 7):
        got = ac.moran_mc(
            values.repartition(parts), graph.repartition(parts), nsim, seed, block=block, bucket_bits=bits, packed=packed
        ).first()
        assert got.n_at_least == at_least
        assert got.p_value == pytest.approx((at_least + 1) / (nsim + 1))


def test_packed_permutations_shuffle_no_values(spark, measured):
    """No window, no sort and no join of values per permutation."""
    x, edges, values, graph = measured
    z = ac._centred(values, [], "area", "x")
    plan = ac._packed_crosses(z, graph.where("src < dst"), [], 99, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "BroadcastHashJoin" in plan


def test_clustered_measure_is_significant(spark):
    cells = [(c + 100 * r, square(c, r)) for r in range(8) for c in range(8)]
    layer = spark.createDataFrame(cells, RINGS)
    values = layer.select(F.col("k").alias("area"), (F.col("k") % 100).cast("double").alias("x"))
    got = ac.moran_mc(drop_missing(values, ["x"]), g.contiguity(layer, "k"), 99).first()
    assert got.n_at_least == 0 and got.p_value == pytest.approx(0.01)
    assert ac.moran_test(values, g.contiguity(layer, "k")).first().p_value < 1e-6


def test_edges_to_areas_without_a_value(spark, measured):
    x, edges, values, graph = measured
    more = graph.unionAll(spark.createDataFrame([(1, 999), (999, 1), (998, 999)], "src long, dst long"))
    # Sums of the same numbers may be added in another order.
    for op in (ac.morans_i, ac.moran_test, lambda *a: ac.moran_mc(*a, nsim=19)):
        assert tuple(op(values, more).first()) == pytest.approx(tuple(op(values, graph).first()))


def test_many_graphs_in_one_job(spark, rows, measured):
    x, edges, values, graph = measured
    half = values.where("area % 2 = 0")
    both = values.withColumn("g", F.lit("all")).unionByName(half.withColumn("g", F.lit("half")))
    graphs = graph.withColumn("g", F.lit("all")).unionByName(graph.withColumn("g", F.lit("half")))
    for op in (ac.morans_i, ac.moran_test, lambda *a, **k: ac.moran_mc(*a, nsim=29, **k)):
        got = {r.g: r[1:] for r in op(both, graphs, by=["g"]).collect()}
        assert got["all"] == pytest.approx(tuple(op(values, graph).first()), nan_ok=True)
        alone = op(half, graph).first()
        assert [v for v in got["half"]] == [pytest.approx(v) if v is not None else None for v in alone]


@pytest.mark.parametrize("queen", [False, True])
def test_points_meet_by_distance(spark, rows, queen):
    """Jitter below the distance, across cell borders too, against all pairs of points."""
    rng = np.random.default_rng(5)
    snap = 1e-6
    shapes = {}
    for r in range(5):
        for c in range(5):
            corners = [(c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1), (c, r)]
            shapes[5 * r + c] = [(x + rng.uniform(-0.7, 0.7) * snap, y + rng.uniform(-0.7, 0.7) * snap) for x, y in corners]
    shapes[90] = [(9.0, 9.0), (9.0 + 0.6e-6, 9.0), (9.5, 9.5)]  # two points near one of the next area
    shapes[91] = [(9.0 + 0.3e-6, 9.0), (8.0, 8.0), (8.0, 9.0)]
    layer = spark.createDataFrame([(k, [p]) for k, p in shapes.items()], "k long, rings array<array<struct<x:double,y:double>>>")

    def partners(a, b):
        return sum(any((x - u) ** 2 + (y - v) ** 2 <= snap**2 for u, v in shapes[b]) for x, y in set(shapes[a]))

    need = 1 if queen else 2
    want = [(a, b) for a in shapes for b in shapes if a != b and min(partners(a, b), partners(b, a)) >= need]
    assert rows(g.contiguity(layer, "k", queen=queen, snap=snap)) == sorted(want)
    border = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0), (3e-9, 1.0)]]), (2, [[(-3e-9, 0.0), (1.0, 0.0), (0.5, -1.0)]])], layer.schema)
    assert rows(g.contiguity(border, "k")) == [(1, 2), (2, 1)]
