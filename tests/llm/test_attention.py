import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from presslink.llm import attention as A
from presslink.llm import catalog

PATH, END = public_tokenizers.path("word_bpe_49k.json"), 49407


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + ["<end>"]


def is_held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def brute_base(rows):
    """Plain definition of the counts and the base score; rows are (id, text)."""
    c = Counter(t for d, x in rows if not is_held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return sorted([(d, is_held(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n,
                    round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for d, x in rows], key=str)


def base_of(df):
    return sorted([(r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df], key=str)


ROWS = [(0, "The cat, the CAT and the dog"), (1, None), (2, ""), (3, " \t\n "), (4, "Ünïted cat\x1cdog"), (5, "the the the"), (5, "the the the"),
        (None, "a null id"), (6, "dog " * 500), (7, "end"), *[(100 + i, f"the cat saw word{i} and word{i % 5}") for i in range(40)]]


@pytest.mark.parametrize("head", [1, 30, 1 << 21])
def test_base_score(spark, monkeypatch, head):
    """Words by broadcast and by the join of the rare ones."""
    monkeypatch.setattr(A, "HEAD", head)
    monkeypatch.setattr(A, "ROUNDS", 1)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in ROWS], "doc_id long, text string, words string, score double").repartition(3)
    got = A.score(df, PATH, END).collect()
    assert base_of(got) == brute_base(ROWS)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    one = {(r.id, r.n_tokens): r.score for r in got}
    assert one[(1, 1)] == pytest.approx(one[(2, 1)]) == pytest.approx(one[(3, 1)])


def test_word_counts_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "TASK_WORDS", 4)
    monkeypatch.setattr(A, "STEP_BYTES", 16)
    monkeypatch.setattr(A, "ROUNDS", 0)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    assert base_of(A.score(df, PATH, END).collect()) == brute_base(ROWS)


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = A.build_vocabulary(np.bincount(rng.zipf(1.3, 20_000) % 5_000, minlength=5_000), rng.random(5_000) < 0.5)
    vector = rng.normal(0, 0.4, A.SIZE)
    after = A.after_table(vocabulary, np.arange(0, 50_000, 7), rng.integers(1, 9, 7143))
    return vocabulary, vector, after.astype(np.float64), rng


def plain_score(vector, after, vocabulary, ids):
    """One id after the other, attention spelled out over exactly the places that its window shows."""
    w, total = A.views(vector), 0.0
    for t in range(len(ids)):
        begin = t // A.HALF * A.HALF - A.HALF              # first place of the window that scores t
        seen = [vocabulary.start if p < 0 else vocabulary.input[ids[p]] for p in range(begin, t)]
        x = np.array([w["emb"][row] + w["pos"][j] for j, row in enumerate(seen)])
        q = x[-1] @ w["q"]
        weights = np.array([math.exp(float(q @ (own @ w["k"])) / math.sqrt(A.DIM)) for own in x])
        c = sum(a * (own @ w["v"]) for a, own in zip(weights / weights.sum(), x))
        z = (x[-1] + c @ w["o"]) @ w["out"] + after[seen[-1]]
        cls = vocabulary.cls[ids[t]]
        total += z[cls] - math.log(np.exp(z).sum()) + vocabulary.log_share[ids[t]]
    return total / math.log(10)


def test_windows_score_each_id_once():
    vocabulary, vector, after, rng = small_model()
    texts = [rng.integers(0, 5_000, n) for n in (1, A.HALF, A.HALF + 1, 3 * A.HALF + 5, 200, 2)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = A.score_ids(vector, after, vocabulary, np.concatenate(texts), first)
    assert got == pytest.approx([plain_score(vector, after, vocabulary, t) for t in texts])
    assert A.score_ids(vector, after, vocabulary, texts[4], np.array([0, 200])) == pytest.approx(got[4:5])
    A.views(vector)["out"][:] *= 4_000                     # logits beyond what exp can hold
    got = A.score_ids(vector.astype(np.float32), after.astype(np.float32), vocabulary, texts[3], np.array([0, len(texts[3])]))
    assert np.isfinite(got).all() and got[0] < 0


def test_probabilities_add_up_to_one():
    vocabulary, vector, after, rng = small_model(2)
    assert np.bincount(vocabulary.cls, np.exp(vocabulary.log_share), minlength=A.CLASSES) == pytest.approx(1)
    z, _ = A.forward(A.views(vector), after, rng.integers(0, A.INPUTS, (3, 2 * A.HALF - 1)))
    every = [np.exp(A.log_probabilities(z.copy(), np.full(len(z), c))) for c in range(A.CLASSES)]
    assert np.sum(every, axis=0) == pytest.approx(1)


def test_gradient_by_differences():
    vocabulary, vector, after, rng = small_model(3)
    windows = A.Windows(rng.integers(0, 5_000, 90), np.array([0, 1, 40, 90]), vocabulary)
    inputs, target, valid = windows.take(np.arange(len(windows.at)))
    cls = vocabulary.cls[windows.ids[target]]
    g, _ = A.gradient(A.views(vector), after, inputs, cls, valid)
    for name, own in A.views(g).items():
        at = int(np.argmax(np.abs(own)))
        weights = A.views(vector)[name].reshape(-1)
        kept, losses = weights[at], []
        for d in (1e-4, -1e-4):
            weights[at] = kept + d
            losses.append(A.gradient(A.views(vector), after, inputs, cls, valid)[1])
        weights[at] = kept
        assert own.reshape(-1)[at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=1e-3), name


def test_gradient_where_plain_exp_overflows(monkeypatch):
    """Each step first goes without the pass that keeps numbers small; where one overflows it is done again with it."""
    vocabulary, vector, after, rng = small_model(5)
    vector, after = vector.astype(np.float32), after.astype(np.float32)
    windows = A.Windows(rng.integers(0, 5_000, 200), np.array([0, 90, 200]), vocabulary)
    inputs, target, valid = windows.take(np.arange(len(windows.at)))
    cls = vocabulary.cls[windows.ids[target]]
    ways, plain = [], A.forward
    monkeypatch.setattr(A, "forward", lambda w, after, inputs, safe=True: ways.append(safe) or plain(w, after, inputs, safe))
    for times, tried in ((1, [False]), (4_000, [False, True])):
        weights = vector.copy()
        A.views(weights)["out"][:] *= times
        ways.clear()
        g, loss = A.gradient(A.views(weights), after, inputs, cls, valid)
        assert ways == tried and np.isfinite(g).all() and math.isfinite(loss)
        wide, _ = A.gradient(A.views(weights.astype(np.float64)), after.astype(np.float64), inputs, cls, valid)
        assert g == pytest.approx(wide, rel=1e-2, abs=1e-3 * float(np.abs(wide).max()))


def test_inputs_of_a_window_are_of_its_text():
    vocabulary, _, _, rng = small_model(6)
    first = np.array([0, 5, 5, 40, 41, 120])
    ids = rng.integers(0, 5_000, 120)
    windows = A.Windows(ids, first, vocabulary)
    inputs, target, valid = windows.take(np.arange(len(windows.at)))
    seen = []
    for text, number, row, places, real in zip(windows.text, windows.number, inputs, target, valid):
        begin = first[text] + number * A.HALF
        own = [vocabulary.start if p < first[text] else vocabulary.input[ids[p]] for p in range(begin - A.HALF, min(begin + A.HALF, first[text + 1]) - 1)]
        assert row[:len(own)].tolist() == own
        seen += places[real].tolist()
    assert seen == list(range(120))


def test_training_learns_from_attention(spark, monkeypatch):
    """A word four words back decides the next one: no table of neighbours knows it."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        key = rng.choice(["red", "blue"], 1)[0]
        other = {"red": "tree", "blue": "house"}[key]
        rows.append((i, " ".join(f"{key} of the very {other} or so" for _ in range(6))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(A, "SHARE", 3)
    monkeypatch.setattr(A, "STEP", 8)

    def held(rounds):
        monkeypatch.setattr(A, "ROUNDS", rounds)
        got = [r for r in A.score(df, PATH, END).collect() if r.held_out]
        return sum(r.score for r in got) / sum(r.n_tokens for r in got)

    assert held(3) > held(0) + 0.03


def test_rows_held_out_teach_nothing(spark):
    monkey = [(d, t) for d, t in ROWS if not is_held(d)] + [(d, "quite other words " * 5) for d, t in ROWS if is_held(d)]
    one, two = (sorted((r.id, r.score) for r in A.score(spark.createDataFrame(x, "doc_id long, text string").coalesce(1), PATH, END).collect()
                       if not r.held_out and r.id is not None) for x in (ROWS, monkey))
    assert [d for d, _ in one] == [d for d, _ in two] and [s for _, s in one] == pytest.approx([s for _, s in two])


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.'sAbÉé1ΣΑß日́’-"), st.characters(codec="utf-8")), max_size=40), max_size=5))
@example(["The cat's Ünïted — 3.5 dogs", "a\x1cb", "rock'n'roll it's", "ab.Σ", "İstanbul ẞ"])
@settings(max_examples=150, deadline=None)
def test_ids_are_the_tokenizers(texts):
    coder = Tokenizer.from_file(PATH)
    for lo, n, h, number, _, before, bytes_of in A._words(pa.array(texts, pa.string())):
        own, first = A.word_codes(PATH).ids(h, number, before, bytes_of)
        for i in range(n):
            assert own[first[i]:first[i + 1]].tolist() == coder.encode(texts[lo + i], add_special_tokens=False).ids


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert A.score(spark.createDataFrame([], schema), PATH, END).collect() == []
    held = next(i for i in range(99) if is_held(i))
    (r,) = A.score(spark.createDataFrame([(held, "some words")], schema), PATH, END).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


def test_long_text_and_query(spark):
    df = spark.createDataFrame([(1, "kappa lyoner " * 30_000), (3, "x" * 200_000)], "doc_id long, text string")
    assert {r.id: r.n_tokens for r in A.score(df, PATH, END).collect()} == {1: 60_001, 3: 2}
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES["op13_attention"](spark, sf).withColumnRenamed("doc_id", "id").collect()
    assert base_of(got) == brute_base([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_every_training_text_is_trained_on(spark):
    own = spark.createDataFrame([(i, i % 9) for i in range(400)] + [(None, 3)], "id long, n_tokens long")
    assert sorted((r.id is None, r.id) for part in A.rounds(own) for r in part.collect()) == [*((False, i) for i in range(400)), (True, None)]


def test_words_are_coded_once_and_by_lines(monkeypatch):
    """A word seen before is not coded again, plain words of a chunk are split together, and a full cache starts again."""
    texts = ["the cat's 3.5 rock'n'roll", "Ünïted the \u65e5\u672c cat", "<|startoftext|> the cat", None, "", "a\x1cb the x\x7fy", "the cat's again"]
    coder, words = Tokenizer.from_file(PATH), A.WordCodes(PATH)
    coded, plain = [], words.encode
    monkeypatch.setattr(words, "encode", lambda new: coded.append(new) or plain(new))
    for cache in (A.CACHE_WORDS, 3):
        monkeypatch.setattr(A, "CACHE_WORDS", cache)
        for _ in range(2):
            for text in texts:
                for _, _, h, number, _, before, bytes_of in A._words(pa.array([text], pa.string())):
                    own, first = words.ids(h, number, before, bytes_of)
                    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
                    want = [i for w in re.findall("[^\x20\x09-\x0d]+", low) for i in coder.encode(w, add_special_tokens=False).ids]
                    assert own.tolist() == want and first.tolist() == [0, len(want)]
        if cache > 3:
            every = [w for new in coded for w in new]
            assert len(every) == len(set(every))
            coded.clear()
            words.clear()
    assert sum(map(len, coded)) > len(every)


def test_ids_take_two_bytes_where_they_fit():
    assert A.id_type(1 << 16).itemsize == 2 and A.id_type((1 << 16) + 1).itemsize == 4
    for size in (1 << 16, 1 << 17):
        kind = A.id_type(size)
        column = pa.array([np.array(x, kind).tobytes() for x in ([1, size - 1], [], [7])], pa.binary())
        ids, first = A._flat(column, size)
        assert ids.tolist() == [1, size - 1, 7] and first.tolist() == [0, 2, 2, 3]
