import numpy as np
import pytest

from tessarea.llm import ann

ROWS = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, every, nearest):
    kept = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None for x in v):
            continue
        x = np.array(v, np.float32).astype(float)
        if len(x) == 8 and np.isfinite(x).all() and (x != 0).any():
            kept.append((i, x))
    kept = list({(i, x.tobytes()): (i, x) for i, x in kept}.values())
    out = {}
    for q, x in kept:
        if q % every == 0:
            found = sorted(((-float(x @ y), i) for i, y in kept if i != q))[:nearest]
            out[q] = [(i, -s) for s, i in found]
    return out


def data(seed=2):
    rnd = np.random.default_rng(seed)
    rows = [(i, rnd.standard_normal(8).astype(np.float32).tolist(), 0, "c") for i in range(400)]
    hot = rows[0][1]
    rows += [(1000 + i, hot, 0, "c") for i in range(150)]  # copies of one vector
    rows += [(2000, None, 0, ""), (2020, [0.0] * 8, 0, ""), (2040, [None] + [1.0] * 7, 0, ""), (2060, [float("nan")] * 8, 0, ""),
             (2080, [float("inf")] + [1.0] * 7, 0, ""), (None, hot, 0, ""), (2100, [1.0] * 5, 0, ""), (2120, [], 0, ""),
             (20, rows[20][1], 0, ""), (2140, [9.0] * 8, 0, "")]
    return rows


def test_all_lists_probed_is_exact(spark):
    rows = data()
    got = {}
    for r in ann.search(spark.createDataFrame(rows, ROWS).repartition(3), probed=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = plain(rows, 20, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_chunks_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 16)
    rows = data()
    few = spark.createDataFrame(rows, ROWS)
    got = ann.search(few, probed=1.0).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {q: 20 for q in plain(rows, 20, 20)}
    three = ann.search(few.where("vec_id in (0, 1, 2)")).collect()
    assert len(three) == 2 and ann.search(few.limit(0)).count() == 0


def test_recall_with_production_parameters(spark):
    """Vectors without structure are the hardest for lists."""
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((3000, 64)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], ROWS)
    got = {}
    for r in ann.search(docs).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, 3000, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("dimension", [3, 65])
def test_scan_keeps_all_within_the_radius(dimension):
    rnd = np.random.default_rng(1)
    x, q = rnd.standard_normal((500, dimension)), rnd.standard_normal(dimension)
    turn = ann.rotation(dimension)
    assert np.allclose(turn @ turn.T, np.eye(dimension))
    distance = ((x - q) ** 2).sum(axis=1)
    radius = float(np.sort(distance)[20])
    alive = ann.scan(x, x @ turn, q, q @ turn, radius)
    assert set(alive.tolist()) <= set(np.flatnonzero(distance <= radius * (1 + 1e-6)).tolist())
    assert len(alive) >= 19
