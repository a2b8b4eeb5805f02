import re
from collections import Counter

import numpy as np
import pytest

from presslink.llm import catalog, mixing


def test_targets():
    assert mixing.fill_targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.fill_targets([1000, 10, 10], [1, 2, 3])
    assert got == [960, 30, 30]
    assert mixing.fill_targets([5, 0], [1, 2]) == [5, 0] and mixing.fill_targets([], []) == [] and mixing.fill_targets([0], [1]) == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_tree_splits_exactly_and_in_order(shards):
    draws = np.array([40, 0, 7, 1])
    parts = [mixing.shard_quotas(i, shards, draws, 3) for i in range(shards)]
    assert sum(p[0] for p in parts).tolist() == draws.tolist()
    before = np.zeros(4, int)
    for own, b in parts:
        assert b.tolist() == before.tolist()
        before = before + own
    assert max(p[0].sum() for p in parts) - min(p[0].sum() for p in parts) <= 4


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def docs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        s = ["hot", "b", "ä", None, "tiny", "Z"][0 if rng.random() < 0.5 else int(rng.integers(0, 6))]
        rows.append((i, "w " * int(rng.integers(0, 60)), s, 1, "x", 0))
    rows += [(1000, None, "b", 1, "x", 0), (1001, " \t\x0b", "empty", 1, "x", 0), (2005, "a b c", "b", 1, "x", 0), (2005, "a b c", "b", 1, "x", 0),
             (None, "no id", "b", 1, "x", 0), (1002, "é\x85\x1cz q", "b", 1, "x", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int, sid string, block int").repartition(5)


@pytest.mark.parametrize("how", [{}, {"block_docs": 8, "shard_blocks": 3}, {"block_docs": 50, "shard_blocks": 1, "seed": 99}])
def test_taken(spark, how):
    rows, df = docs(spark)
    got = mixing.taken(df, **how).collect()
    assert Counter((r.id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
    by = Counter()
    for _, t, s, *_ in rows:
        by[s] += size(t)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.fill_targets([by[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))])))
    source = {r[0]: r[2] for r in rows}
    sums = Counter()
    for r in got:
        s = source[r.id]
        assert r.source_size == by[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        sums[s] += r.taken
    for s in names:
        assert sums[s] <= want[s] + 1e-6 and want[s] - sums[s] < 60            # the largest row
    again = mixing.taken(df.repartition(3), **how).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_rows_are_the_copies(spark):
    _, df = docs(spark)
    how = {"block_docs": 20, "shard_blocks": 4}
    copies = Counter()
    for r in mixing.taken(df, **how).collect():
        copies[r.id] += r.copies
    out = mixing.mix(df, **how)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies


def test_empty_table(spark):
    df = docs(spark)[1].limit(0)
    assert mixing.taken(df).collect() == [] and mixing.mix(df).collect() == []


def test_query(spark):
    got = catalog.QUERIES["op8_mixing"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.taken <= 3 * r["size"] for r in got)
