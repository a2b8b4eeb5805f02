import hashlib
import random

import numpy as np
import pytest

from presslink.llm import catalog, suffix

BIG = 1 << 62


def brute(rows, min_len=50):
    """rows: (doc_id, text) -> sorted results by the definition."""
    first = {}
    data = [(BIG if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - min_len + 1):
            s = b[p:p + min_len]
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, b), (orig, _) in zip(data, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - min_len + 1):
            if first[b[p:p + min_len]] < i:
                gone[p:p + min_len] = b"\1" * min_len
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((orig, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "d", 1) for i, t in rows], "doc_id long, text string, digest string, n_bytes int")
    got = suffix.dedup(df.repartition(3), **kw).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(tuple, got), key=str)


def cases():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh éñ") for _ in range(rnd.randrange(2, 9)))
    passage = [" ".join(word() for _ in range(n)) for n in (9, 14, 40)]
    rows = [(0, ""), (1, None), (2, "short"), (3, "a" * 300), (4, "a" * 120), (5, "ab" * 200), (6, "x" + "ab" * 60)]
    for i in range(10, 60):
        parts = [" ".join(word() for _ in range(rnd.randrange(1, 60)))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passage)
            a = rnd.randrange(0, 12)
            parts += [p[a:], " ".join(word() for _ in range(rnd.randrange(0, 20)))]
        rows.append((i, rnd.choice(["", " "]).join(parts)))
    rows += [(100, rows[20][1]), (101, rows[20][1]), (9, rows[21][1]), (9, rows[21][1]), (9, rows[22][1]), (None, rows[23][1]),
             (None, passage[2]), (200, passage[0] * 400)]
    rows += [(300 + i, passage[1] + "!") for i in range(30)]
    return rows


@pytest.mark.parametrize("kw", [{}, {"group_bytes": 900, "bucket_anchors": 40},
                                {"group_bytes": 3000, "bucket_anchors": 100, "wide": 1}, {"wide": 0}])
def test_brute_force(spark, kw):
    rows = cases()
    assert run(spark, rows, **kw) == brute(rows)


def test_other_length(spark):
    rows = cases()[:40]
    assert run(spark, rows, min_len=12, group_bytes=2000, bucket_anchors=100) == brute(rows, 12)


def test_smaller_neighbours():
    rng = np.random.default_rng(0)
    v, run_ = rng.integers(0, 9, 200), np.sort(rng.integers(0, 12, 200))
    prev, nxt = suffix.smaller_neighbours(v, run_)
    for i in range(200):
        p = next((j for j in range(i - 1, -1, -1) if run_[j] == run_[i] and v[j] < v[i]), i)
        q = next((j for j in range(i + 1, 200) if run_[j] == run_[i] and v[j] < v[i]), i)
        assert (prev[i], nxt[i]) == (p, q)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, catalog.QUERIES["op9_suffix"](spark, sf).collect()), key=str) == brute(rows)
