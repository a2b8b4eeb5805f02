import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from presslink.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """The whole text through the libraries themselves: ids and token bytes of both."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}

    def a_bytes(i):
        return bytes(byte[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], []
        x = [(i, a_bytes(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, b_bytes(i)) for i in b.encode(text)]
        want = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == want == b"".join(t for _, t in y) else ([], [])

    return run


def brute(plain, rows):
    """Plain definition: every pair of tokens is compared."""
    out, counts = [], Counter()
    for doc, text in rows:
        x, y = plain(text)
        ends_x = np.cumsum([len(t) for _, t in x]).tolist()
        ends_y = np.cumsum([len(t) for _, t in y]).tolist()
        links = [(i, j) for i, e in enumerate(ends_x) for j, f in enumerate(ends_y) if e == f]
        said, i0, j0 = [], 0, 0
        for i, j in links:
            said.append(",".join(str(k) for k, _ in x[i0:i + 1]) + "|" + ",".join(str(k) for k, _ in y[j0:j + 1]))
            i0, j0 = i + 1, j + 1
        pairs = [(x[i][0], y[j][0]) for i, j in links]
        counts.update(pairs)
        out.append((doc, len(x), len(y), len(said), pairs, hashlib.sha256(";".join(said).encode()).hexdigest() if said else ""))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted([(doc, a, b, g, len(p), sum(counts[q] == most[q[1]] for q in p), sum(counts[q] for q in p), s)
                   for doc, a, b, g, p, s in out], key=str)


TEXTS = ["The lyoner, don't stop.\nA new  line\n\n  indented\tand tabs ", "", None, "   ", " a", "a ", "\n", "x\n y", "Élan ñandú: 日本語 😀!",
         "bad ▁ mark", "<|endoftext|> and <s> </s> <0x41>", "no break wide\x1cfs\x85nel", "\x00nul", "naïve é", "ﬁ ① Å",
         "word" * 200, "aa " * 300, "The lyoner, don't stop.\nA new  line\n\n  indented\tand tabs ", "1234567890 3.14 -- ... ///", "tail\n\n"]


def result(df):
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r) for r in df.select(*names).collect()], key=str)


@pytest.mark.parametrize("joined", [False, True])
def test_brute_force(spark, plain, monkeypatch, joined):
    rows = list(enumerate(TEXTS)) + [(3, "The lyoner"), (3, "The lyoner"), (None, "The lyoner ran")]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12).collect()
             if len(r.text) < 3000]
    monkeypatch.setattr(alignment, "STEP_CHARS", 500)
    if joined:
        monkeypatch.setattr(alignment, "MAX_PAIRS", 0)
        monkeypatch.setattr(alignment, "deal", lambda *a: __import__("presslink.llm.common", fromlist=["deal"]).deal(*a, heavy_rows=5))
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, n int, pairs string").repartition(3)
    assert result(alignment.align(df, *PATHS)) == brute(plain, rows)


def test_groups_cover_all_tokens(spark, plain):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in alignment.groups(df, *PATHS).collect():
        x, y = plain(TEXTS[r.id])
        assert r.a_ids == [i for i, _ in x] and r.b_ids == [i for i, _ in y]
        assert [i for g in r.groups for i in range(g.a_from, g.a_to)] == list(range(len(x)))
        for g in r.groups:
            assert b"".join(t for _, t in x[g.a_from:g.a_to]) == b"".join(t for _, t in y[g.b_from:g.b_to])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(df, *PATHS).collect() == [] and alignment.groups(df, *PATHS).collect() == []


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.'sA日é  ▁<>x1"), st.characters(codec="utf-8")), max_size=40),
                min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_chunks_give_the_ids_of_whole_texts(texts):
    for coder in (alignment.byte_level(PATHS[0]), alignment.piece_level(PATHS[1])):
        for own, text in zip(coder.encode_texts(texts), texts):
            assert np.frombuffer(own, "<u4").tolist() == (list(coder.whole(text)) if text else [])


@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_gallop(texts):
    """Every text's lists end together; those of several texts follow each other."""
    a, b, a_first, b_first, base = [], [], [0], [0], 0
    for x, y in texts:
        a += [base + v for v in sorted(x | {61})]
        b += [base + v for v in sorted(y | {61})]
        base += 61
        a_first.append(len(a))
        b_first.append(len(b))
    i, j = alignment.common_ends(*(np.array(v, np.int64) for v in (a, a_first, b, b_first)))
    assert [a[k] for k in i] == [b[k] for k in j] == sorted(set(a) & set(b))
    start = np.zeros(len(a), np.int64)
    assert alignment.gallop(np.array(a), np.array(b), start).tolist() == np.searchsorted(b, a).tolist()


def test_very_long_text(plain):
    text = "kappa lyoner " * 40_000 + "x" * 50_000
    got = alignment.Aligned([None, text, ""], alignment.byte_level(PATHS[0]), alignment.piece_level(PATHS[1]))
    x, y = plain(text)
    assert got.a.tolist() == [i for i, _ in x] and got.b.tolist() == [i for i, _ in y]
    common = sorted(set(np.cumsum([len(t) for _, t in x]).tolist()) & set(np.cumsum([len(t) for _, t in y]).tolist()))
    assert got.first.tolist() == [0, 0, len(common), len(common)]
