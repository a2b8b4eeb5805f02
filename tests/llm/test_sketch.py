import hashlib
import random
import re

import numpy as np
import pytest

from presslink.llm import catalog, sketch


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edit(rows):
    """(id, text) in any order -> per row (id, text, next text, edited text) in order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for n, (i, t) in enumerate(rows):
        nxt = rows[(n + 1) % len(rows)][1]
        h = len(t) // 2
        out.append((i, t, nxt, t[:len(t) - h] + nxt[:h]))
    return out


def compare(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest(), t, x, e) for i, t, x, e in edit(rows)), key=key)
    have = sorted(((r.id, r.n_chars, r.edited_sha256, r) for r in got), key=key)
    assert [w[:3] for w in want] == [h[:3] for h in have]
    for (_, _, _, t, x, e), (_, _, _, r) in zip(want, have):
        for est, other in ((r.near_edited, e), (r.near_next, x)):
            true = jaccard(t, other)
            assert 0 <= est <= 1
            if len(shingles(t) | shingles(other)) <= sketch.K:
                assert est == pytest.approx(true)
            else:
                assert abs(est - true) < 0.16
    return have


def rows():
    rnd = random.Random(4)
    word = lambda: rnd.choice(["é", "ab", "the", "x,", "中文", "tail"]) + str(rnd.randrange(300))
    out = [(i, rnd.choice([" ", "\n", "\t "]).join(word() for _ in range(rnd.choice([0, 1, 4, 5, 30, 900])))) for i in range(0, 300, 5)]
    return out + [(7, None), (8, ""), (9, " \n"), (10, "😀" * 7), (11, "one two"), (301, out[3][1]), (302, out[3][1]), (302, out[3][1]),
                  (302, "other"), (None, "null id words"), (None, None), (-4, "first"), (1 << 60, "far away id")]


@pytest.mark.parametrize("size", [300, 1 << 23])
def test_next_and_edited(spark, size, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_BYTES", size)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, r string, guest int").repartition(4)
    compare(sketch.with_next(df).collect(), rows())


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    r, = sketch.with_next(df).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d").hexdigest()
    assert sketch.with_next(df.limit(0)).collect() == []


def test_equal_texts_equal_fingerprints_any_batch():
    rnd = random.Random(1)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(30_000))
    a, _, c = sketch.sketches([long, "between", long])
    assert (a == c).all() and (a == sketch.sketches([long])[0]).all() and len(a) == sketch.K
    assert abs(sketch.distinct_count(a) / 30_000 - 1) < 0.25


def test_merge_and_estimates(spark):
    rnd = random.Random(2)
    w = [str(rnd.randrange(10**6)) for _ in range(4000)]
    a, b = " ".join(w[:3000]), " ".join(w[1000:])
    x, y = sketch.sketches([a, b])
    whole = set(sketch.sketches([a], k=10**6)[0].tolist()) | set(sketch.sketches([b], k=10**6)[0].tolist())
    assert sketch.merge(x, y).tolist() == sorted(whole)[:sketch.K]
    assert abs(sketch.resemblance(x, y) - 0.5) < 0.12 and abs(sketch.containment(x, y) - 2 / 3) < 0.15
    df = spark.createDataFrame([(1, a, "g"), (2, b, "g"), (3, "x y z", "h"), (4, "", "i")], "doc_id long, text string, g string")
    parts = sketch.sketch_documents(df).join(df.select("doc_id", "g"), sketch.F.col("id") == sketch.F.col("doc_id"))
    got = {r.g: r for r in sketch.merge_by(parts, "g").collect()}
    assert sketch.from_text(got["g"].sketch).tolist() == sketch.merge(x, y).tolist()
    assert got["h"].n_shingles == 1 and got["i"].n_shingles == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    compare(catalog.QUERIES["op6_sketch"](spark, sf).withColumnRenamed("doc_id", "id").collect(), docs)
