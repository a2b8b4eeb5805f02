import random
import re

import numpy as np
import pytest
import xxhash

from presslink.llm import catalog, simhash


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance=4):
    n = len(ids)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    f = np.array(fps, dtype=np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= distance):
            parent[root(int(j))] = root(i)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(n)]


def texts():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    out = ["", None, "  \t\n", "One", "one", "ONE two three", "É é ſ words here", "a b c d e f", "x " * 5000]
    for _ in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([5, 30, 200]))]
        out.append(" ".join(base))
        for _ in range(rnd.choice([0, 1, 4])):
            near = list(base)
            near[rnd.randrange(len(near))] = rnd.choice(vocab)
            out.append(" ".join(near))
    return out


def test_index_property():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 1 << 23, 3000)
    for d in range(3):
        flip = np.array([sum(1 << int(b) for b in rng.choice(23, d, replace=False)) for _ in w], dtype=np.int64)
        for a, b in zip(simhash.indices(w), simhash.indices(w ^ flip)):
            assert (set(a) & set(b)) - {-1}


def test_any_four_errors_share_a_key():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in x], dtype=np.uint64)
    ra, ka = simhash.keys(x)
    rb, kb = simhash.keys(x ^ flips)
    shared = set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))
    assert {r for r, _ in shared} == set(range(len(x)))


def cluster(rng, n, bits):
    centre = int(rng.integers(0, 1 << 63))
    return [centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, bits + 1)), replace=False)) for _ in range(n)]


@pytest.mark.parametrize("bucket_rows,group_rows", [(100_000, 4096), (20, 16)])
def test_links_join_as_all_pairs_do(spark, bucket_rows, group_rows):
    rng = np.random.default_rng(6)
    fps = list(dict.fromkeys(cluster(rng, 150, 5) + cluster(rng, 40, 2) + rng.integers(0, 1 << 63, 100).tolist() + [0]))
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = simhash.components(simhash.fuzzy_links(df, 4, group_rows, bucket_rows)).collect()
    got = {r.node: r.root for r in roots}
    want = brute_components([s for s, in signed], fps)
    assert [got.get(s, s) for s, in signed] == want


def test_operator_against_brute_force(spark):
    rows = [(i, t, "en", "s", 1, "clash", "k") for i, t in enumerate(texts())]
    rows += [(500 + i, "same words in all of these rows", "en", "s", 1, "clash", "k") for i in range(50)]
    rows += [(500, "same words in all of these rows", "en", "s", 1, "c", "k"), (None, "nobody has this id at all", "", "", 0, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, id string")
    got = sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, brute_components([r[0] for r in rows], fps)), key=str)
    assert got == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, catalog.QUERIES["op4_simhash"](spark, sf).collect()))
    fps = [brute_fp(r.text) for r in rows]
    comp = brute_components([r.doc_id for r in rows], fps)
    assert got == sorted((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, comp))
