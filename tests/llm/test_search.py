import math
import re
from collections import Counter

import numpy as np
import pytest

from presslink.llm import catalog, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Plain definition: docs and items are lists of (id, text)."""
    counts = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    total, n_docs = sum(n for _, _, n in counts), sum(n > 0 for _, _, n in counts)
    out = []
    for item, text in items:
        rows = []
        for d, c, n in counts:
            s = 0
            for term in terms(text):
                if c[term]:
                    df = sum(term in x for _, x, _ in counts)
                    m = 75 + 25 * n * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * c[term] // (1000 * c[term] + 12 * m))
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, row[3], -row[0]) for r, row in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


DOCS = [(5, "Alpha beta, BETA-gamma x1"), (2, "alpha beta beta gamma x1"), (9, None), (1, ""), (4, "--- !!"), (7, "Éa ñandú alpha"),
        (7, "Éa ñandú alpha"), (None, "beta beta beta"), (3, "alpha " * 400 + "zeta"), (8, "éa alpha")]
ITEMS = [(1, "alpha beta beta"), (2, "ñandú Éa"), (3, "nothing here"), (4, None), (5, "ZETA x1"), (1, "alpha beta beta"), (None, "gamma")]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_brute_force(spark, k):
    docs = spark.createDataFrame([(d, t, "s", 0) for d, t in DOCS], "doc_id long, text string, item_id string, score int").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    assert rows_of(search.search(docs, items, k=k)) == brute(DOCS, ITEMS, k)


def test_blocks_and_small_steps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(120)]
    items = [(int(i), " ".join(rng.choice(words, 6))) for i in range(9)]
    want = brute(docs, items, 7)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(search.search(d, i, k=7)) == want
    monkeypatch.setattr(search, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(search, "STEP_POSTINGS", 5)
    monkeypatch.setattr(search, "STEP_BYTES", 64)
    assert rows_of(search.search(d, i, k=7)) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_equal_hashes_are_told_apart():
    index = search.build_index(["aa bb"])
    raw = np.frombuffer(b"cc bb", np.uint8)
    fake = search.Index(index.hashes.copy(), index.raw, index.begin, index.first, index.item, index.times, 1)
    start, end, _ = search.word_spans(raw, np.array([0, 5]), search.SEPARATOR)
    wrong = search.word_hashes(raw, start, end)[0]
    at = [index.raw[a:b].tobytes() for a, b in zip(index.begin, index.begin[1:])].index(b"aa")
    fake.hashes[at] = wrong
    order = np.argsort(fake.hashes)
    if (order == np.arange(2)).all():                      # the table stays sorted with the forged hash
        assert search.term_counts(raw, np.array([0, 5]), fake)[2].tolist() == [1 - at]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "kappa " + "x" * 3_000_000 + " kappa"), (2, "kappa")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "kappa")], "item_id long, text string")
    assert [(r.doc_id, r.rank) for r in search.search(docs, items).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_query_on_a_table(spark):
    got = catalog.QUERIES["op11_search"](spark, "/root/testdata/sf0.001").collect()
    assert max(r["rank"] for r in got) <= 20 and min(r.score for r in got) > 0
