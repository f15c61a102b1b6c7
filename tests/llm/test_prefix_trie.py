import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessarea.llm import prefix_trie

TALKS = "conv_id long, turn long, role string, text string, length string, owner int"


def plain(rows):
    """The nodes by nested loops over all prefixes."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(original.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, talk in made.items():
        for d in range(len(talk) + 1):
            members[talk[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if made[c] == p)
        out.append(
            (
                min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]),
                sum(not children[q] for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out)


def talks(seed=1):
    rnd = random.Random(seed)
    rows = []
    for c in [0, 1, 2, 3, 4, 5, 6, 7, 99, 100, 101, 150, 305, 306, 307, 2000, 2001, 2002]:
        for turn in range(rnd.choice([0, 1, 2, 3, 7, 9])):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "é🙂"]) * rnd.choice([1, 1, 2])))
    copies = [(c, t, "user", f"same {t}") for c in range(5000, 5030) for t in range(8)]
    odd = [(9, None, None, None), (9, 1, "user", ""), (9, 1, "user", ""), (9, 1, "assistant", "z" * 3000), (None, 1, "user", "lost"),
           (700, 3, "user", "only"), (10**12, 0, "", "x"), (10**12, 0, None, "x")]
    return rows + copies + odd


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TALKS).repartition(parts)
    return sorted(tuple(r) for r in prefix_trie.nodes(df).select(*prefix_trie.COLUMNS).collect())


@pytest.mark.parametrize("seed, parts", [(1, 3), (2, 7)])
def test_nodes_against_brute_force(spark, seed, parts):
    rows = talks(seed)
    assert found(spark, rows, parts) == plain(rows)


def test_one_conversation_spread_over_partitions(spark):
    """Running totals of a conversation that spans many partitions, and its copy."""
    rows = [(c, t, "user", f"turn {t}") for c in (100, 200) for t in range(300)] + [(300, t, "user", "other") for t in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert found(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_crowded_sketch_changes_nothing(spark, monkeypatch):
    """With few counters nearly all prefixes are grouped exactly: the same nodes."""
    monkeypatch.setattr(prefix_trie, "LEAST", 8)
    monkeypatch.setattr(prefix_trie, "MOST", 8)
    rows = talks(3)
    assert found(spark, rows) == plain(rows)


def test_few_and_no_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(5, 0, "user", "x")], [(7, t, "user", "x") for t in range(9)], [(2, 0, "u", "x"), (3, 0, "u", "x")]):
        assert found(spark, rows) == plain(rows)
