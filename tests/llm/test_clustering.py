import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tessarea.llm import clustering

ROWS = "vec_id long, embedding array<float>, label int, cluster string"


def plain(data, clusters=clustering.CLUSTERS, rounds=clustering.ROUNDS, seed=clustering.SEED):
    """All distances in plain integers."""
    kept = [
        (i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v])
        for i, v in data
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)
    ]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:clusters]]

    def assign():
        return [
            min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept
        ]

    for _ in range(rounds):
        of = assign()
        for k in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, of) if c == k]
            if members:
                centroids[k] = [sum(column) // len(members) for column in zip(*members)]
    return sorted(((str(i), k, d) for (i, _), (d, k) in zip(kept, assign()))), centroids


def vectors(n, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, 64))
    return [(int(i), (centres[i % 7] + spread * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(n)]


def found(spark, data, **options):
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in data], ROWS).repartition(3)
    assigned, centroids = clustering.cluster(df, **options)
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in assigned.collect()), centroids


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_clusters_against_all_distances(spark, spread):
    nan, inf = float("nan"), float("inf")
    data = vectors(300, spread=spread)
    data += [(None, data[3][1]), (5, data[9][1]), (5, data[9][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [nan]),
             (903, [inf] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [0.0] * 64), (906, [])]
    got, centroids = found(spark, data)
    want, wanted = plain(data)
    assert got == want and centroids.tolist() == wanted


def test_ties_and_empty_clusters(spark):
    """Copies of one vector start many equal centroids: the smallest number takes all."""
    data = [(i, [0.5] * 64) for i in range(60)] + [(100 + i, [-0.25 * (i % 2)] * 64) for i in range(4)]
    got, centroids = found(spark, data, clusters=20)
    want, wanted = plain(data, clusters=20)
    assert got == want and centroids.tolist() == wanted


def test_fewer_vectors_than_clusters_and_none(spark):
    got, centroids = found(spark, vectors(3))
    assert [c for _, c, _ in got] and [d for *_, d in got] == [0, 0, 0] and len(centroids) == 3
    assert found(spark, [(1, None)])[0] == []
    assert clustering.inertias(*clustering.cluster(spark.createDataFrame([(1, None, 1, "x")], ROWS))).collect() == []


def test_components_that_leave_63_bits_are_refused(spark):
    with pytest.raises(PySparkException):
        found(spark, [(1, [1e9] + [0.0] * 63)])


def test_bounds_never_exceed_distances_and_save_work():
    rng = np.random.default_rng(3)
    x = np.array([v for _, v in vectors(400, spread=0.1)]) * 256
    x = np.floor(x).astype(np.int64)
    centroids, pivots = x[rng.choice(400, 40, replace=False)], x[:6]
    assigner = clustering.Assigner(centroids, pivots)
    cached = clustering._distances(x, pivots)
    exact = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    assert (assigner.bounds(cached) <= exact).all()
    best, distance = assigner.nearest(x, cached)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert assigner.checked < 0.5 * exact.size
