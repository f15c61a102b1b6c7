import random
from collections import defaultdict

import pytest

from tessarea.llm import line_dedup

DOCS = "doc_id long, text string, source string, n_lines string, at string"


def plain(rows, least):
    sites = defaultdict(set)
    for _, t, s, *_ in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if line.strip(" ") and s is not None:
                sites[line.strip(" ")].add(s)
    out = []
    for i, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if len(sites[x.strip(" ")]) < least or not x.strip(" ")]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None))
    return out


def key(r):
    return tuple((v is None, str(v)) for v in r)


@pytest.mark.parametrize("near", [1.0001, 1.5, 100.0])
def test_against_sets_of_sites(spark, near):
    rnd = random.Random(6)
    common = [f"boiler {k}" for k in range(8)]
    rows = []
    for i in range(300):
        site = rnd.choice([f"s{k}" for k in range(9)] + [None])
        lines = [rnd.choice(common[: rnd.randrange(1, 9)]) for _ in range(rnd.randrange(4))] + [f"own {i}", "", "  "]
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), site, "c", "c"))
    rows += [(None, "boiler 0\nx", "s1", "", ""), (900, None, "s2", "", ""), (901, "", None, "", ""), (902, " boiler 0 ", "s1", "", ""),
             (3, rows[3][1], "s4", "", ""), (903, "line\n" * 20_000, "s1", "", "")]
    rows += [(1000 + k, "everywhere", f"t{k}", "", "") for k in range(200)]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, DOCS).repartition(4), near=near)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "at", "n_removed"]
    got = got.select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, line_dedup.MIN_SITES), key=key)


def test_empty(spark):
    assert line_dedup.remove_boilerplate(spark.createDataFrame([], DOCS)).count() == 0
