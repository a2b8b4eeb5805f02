"""Fuzzy matching: scorer goldens, exact top-k vs brute force, and the matcher flows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslink.functions.similarity import token_set_ratio
from presslink.operators import matching as mt
from presslink.operators import nearest
from presslink.operators.strings import StringBlock, scores
from presslink.plans.flows import match_contributions


def test_token_set_ratio_goldens():
    assert token_set_ratio("acme widgets", "acme widgets llc") == 100.0     # subset
    assert token_set_ratio("", "acme") == 0.0
    assert token_set_ratio("microsoft", "microsft") == pytest.approx(94.11764705882354)
    assert token_set_ratio("new york mets", "new york yankees") == pytest.approx(76.19047619047619)
    assert token_set_ratio("b a", "a b") == 100.0


def test_token_set_ratio_symmetric_and_bounded():
    rnd = random.Random(7)
    words = ["acme", "acne", "widget", "widgets", "global", "fund", "ireland", "funds", "cab", "american"]
    for _ in range(500):
        a = " ".join(rnd.sample(words, rnd.randint(0, 3)))
        b = " ".join(rnd.sample(words, rnd.randint(0, 3)))
        s = token_set_ratio(a, b)
        assert 0.0 <= s <= 100.0 and s == pytest.approx(token_set_ratio(b, a))


def brute_topk(mentions, contribs, field, k):
    out = {}
    for m in set(mentions):
        scored = sorted(((token_set_ratio(m, c[field]), i) for i, c in contribs.items()), key=lambda t: (-t[0], t[1]))
        out[m] = [(i, round(s, 9)) for s, i in scored[:k]]
    return out


def nearest_of(spark, mentions, contribs, k=5, **options):
    m_df = spark.createDataFrame([(m,) for m in set(mentions)], "m string")
    c_df = spark.createDataFrame([(i, c["name"], c["employer"]) for i, c in contribs.items()],
                                 "idx long, name_norm string, emp_norm string")
    top = mt.fuzzy_topk(m_df, mt.contributor_strings(c_df, k), k, **options)
    out = {"name": {}, "employer": {}}
    for r in top.orderBy("field", "m", "rank").collect():
        out[r.field].setdefault(r.m, []).append((r.idx, round(r.score, 9)))
    return out


@pytest.mark.parametrize("block,max_blocks,small,seed", [(128, 100_000, 0, 11), (3, 100_000, 0, 12), (2, 7, 0, 13), (128, 100_000, 4096, 14)])
def test_fuzzy_topk_equals_brute_force(spark, monkeypatch, block, max_blocks, small, seed):
    monkeypatch.setattr(nearest, "MAX_BLOCKS", max_blocks)
    monkeypatch.setattr(nearest, "HOT_ROWS", 20)
    rnd = random.Random(seed)
    vocab = ["acme", "acne", "widget", "widgets", "global", "fund", "funds", "cab", "american", "ireland", "group", "ñandú", "x1"]
    names = [" ".join(rnd.sample(vocab, rnd.randint(1, 3))) for _ in range(60)]
    contribs = {i: {"name": rnd.choice(names), "employer": rnd.choice(names + [""])} for i in range(120)}
    mentions = [rnd.choice(names) + rnd.choice(["", "x"]) for _ in range(25)] + ["", "qqq", "fund fund fund", "american", "日本"]
    got = nearest_of(spark, mentions, contribs, block=block, small=small)
    for field in ("name", "employer"):
        assert got[field] == brute_topk(mentions, contribs, field, 5)


def test_fuzzy_topk_one_token_in_half_of_all_names(spark, monkeypatch):
    """A hot token, strings without any token in common, and few records per field."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("aeiourstln", k=rnd.randint(2, 8)))
    names = [(("american " if i % 2 else "") + " ".join(word() for _ in range(rnd.randint(1, 3)))) for i in range(300)]
    contribs = {i: {"name": n, "employer": rnd.choice(names[:4])} for i, n in enumerate(names)}
    mentions = [("american " if i % 3 else "") + word() + " " + word() for i in range(40)]
    got = nearest_of(spark, mentions, contribs, block=4, small=0)
    for field in ("name", "employer"):
        assert got[field] == brute_topk(mentions, contribs, field, 5)


def test_fuzzy_topk_scores_few_of_all_pairs(spark):
    """Names of many words: the exact answer takes a small part of all pairs, and a smaller part of more names."""
    def share(n):
        rnd = random.Random(9)
        words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(4, 9))) for _ in range(n // 4)]
        names = list({" ".join(rnd.choices(words, k=rnd.randint(2, 3))) for _ in range(n)})
        mentions = [rnd.choice(names)[1:] for _ in range(60)]
        counter = spark.sparkContext.accumulator(0)
        contribs = {i: {"name": x, "employer": ""} for i, x in enumerate(names)}
        got = nearest_of(spark, mentions, contribs, block=32, small=0, scored=counter)
        assert got["name"] == brute_topk(mentions, contribs, "name", 5)
        return counter.value / (len(set(mentions)) * len(names))

    small, large = share(400), share(3200)
    assert large < 0.25 and large < small


@pytest.mark.parametrize("small", [0, 4096])
def test_fuzzy_topk_edges(spark, small):
    contribs = {i: {"name": n, "employer": ""} for i, n in enumerate(["b", "", "a", "b", "x" * 5000, "a b"])}
    mentions = ["", "a", "b a", "x" * 4000, "zzz"]
    assert nearest_of(spark, mentions, contribs, k=3, small=small)["name"] == brute_topk(mentions, contribs, "name", 3)
    assert nearest_of(spark, [], contribs, small=small) == {"name": {}, "employer": {}}
    assert nearest_of(spark, ["a"], {}, small=small) == {"name": {}, "employer": {}}


@pytest.mark.parametrize("text", ["a fund", "fund", "american cab", "", "zz é"])
def test_bounds_are_never_below_the_score(text):
    rnd = random.Random(2)
    vocab = ["a", "fund", "american", "cab", "zz", "é", "funds", "ac"]
    for _ in range(300):
        other = " ".join(rnd.choices(vocab, k=rnd.randint(0, 5)))
        a, b = nearest.token_form(text), nearest.token_form(other)
        shared = len(" ".join(set(a.split()) & set(b.split())))
        bag = nearest.bag_bound(nearest.bag(a), len(a), nearest.bag(b)[:, None], np.array([len(b)]))[0]
        side = 200 * shared / (shared + min(len(a), len(b))) if shared else 0
        assert token_set_ratio(text, other) <= max(bag, side) + 1e-9


def run_flow(spark, mentions, contribs, replies):
    m = spark.createDataFrame(list(enumerate(mentions)), "mention_id long, name string")
    c = spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(contribs)],
                              "idx long, contributor_name string, contributor_employer string")
    r = spark.createDataFrame([(i, rep, err) for i, (rep, err) in replies.items()],
                              "mention_id long, reply string, error string")
    return match_contributions(m, c, replies=r)


def lines(res):
    return [x.line for x in res.report.orderBy("mention_id", "line_no").collect()]


def test_accept(spark):
    res = run_flow(spark, ["Acme Widgets"], [("Acme Widgets LLC", "Other"), ("Zed", "Zed Co")],
                   {0: ('{"decision": "MATCH", "index": 1, "reason": "Same"}', None)})
    assert lines(res) == ["Matches Report", "=" * 40, "", "Mention: Acme Widgets",
                          "Decision: ACCEPT (Name score=100) -> Contributor Name='Acme Widgets LLC', "
                          "Contributor Employer='Other'", " - Same", ""]


def test_no_match_suppressed_and_gate(spark):
    res = run_flow(spark, ["Acme Widgets", "Qqqq"], [("Acme Widgets LLC", "Other")],
                   {0: ('{"decision": "NO_MATCH", "index": 0, "reason": "Different"}', None),
                    1: ('{"decision": "MATCH", "index": 1, "reason": "x"}', None)})
    assert lines(res) == ["Matches Report", "=" * 40, ""]
    assert res.prompts.count() == 1          # "Qqqq" is gated out (best score <= 62)


def test_call_error_and_unparseable(spark):
    res = run_flow(spark, ["Acme Widgets", "Acme Widgets"], [("Acme Widgets LLC", "Other")],
                   {0: (None, "APIError: boom"), 1: ("nonsense not json", None)})
    got = lines(res)
    assert got[3:] == ["Mention: Acme Widgets", "Decision: REVIEW (LLM error)", " - APIError: boom", "",
                       "Mention: Acme Widgets", "Decision: REVIEW (LLM)", " - Unparseable LLM response", ""]


def test_adjudication_typing(spark):
    df = spark.createDataFrame([(0, '{"decision": "match", "index": "2"}'), (1, '{"decision": "MATCH", "index": 1.7}'),
                                (2, '{"decision": "MATCH", "index": null}'), (3, '{"index": 1}'),
                                (4, '{"decision": true, "index": 0, "reason": 5}'),
                                (5, '{"decision": "MATCH", "index": " 3 "}'), (6, '{"decision": "MATCH", "index": "1.5"}')],
                               "mention_id long, reply string")
    got = [(r["decision"], r["index"], r["reason"]) for r in mt.parse_adjudication(df).orderBy("mention_id").collect()]
    unparseable = ("REVIEW", 0, "Unparseable LLM response")
    assert got == [("MATCH", 2, ""), ("MATCH", 1, ""), unparseable, ("REVIEW", 1, ""), ("TRUE", 0, "5"),
                   ("MATCH", 3, ""), unparseable]


def test_candidate_order_and_employer_field(spark):
    res = run_flow(spark, ["Globex"], [("Someone Else", "Globex Corporation"), ("Globex Inc", "Initech")],
                   {0: ('{"decision": "MATCH", "index": 2, "reason": "employer"}', None)})
    ranked = res.ranked.orderBy("cand_rank").collect()
    # two records only: both are in both top-5 lists; ties on 100 keep the name-list order
    assert [(r.idx, r.name_score, r.employer_score) for r in ranked] == [(1, 100, 15), (0, 33, 100)]
    assert "ACCEPT (Employer score=100)" in lines(res)[4]


@pytest.mark.parametrize("hot_rows", [7, 100_000])
def test_hot_names_are_dealt(spark, hot_rows):
    """One name on half of all mention rows: same rows as a plain join, in many shares."""
    many = spark.createDataFrame([(i, "hot" if i % 2 else f"n{i % 9}") for i in range(200)], "mention_id long, norm string")
    few = spark.createDataFrame([("hot", r, f"hot{r}") for r in (1, 2)] + [("n4", 1, "x"), ("gone", 1, "y")],
                                "norm string, index long, detail string")
    for how, on in (("inner", ()), ("left", ("index",))):
        left = many if how == "inner" else many.withColumn("index", F.lit(2).cast("long"))
        got = mt.join_hot(left, few, "norm", "mention_id", on=on, how=how, hot_rows=hot_rows)
        want = left.join(few, ["norm", *on], how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_vector_scores_equal_pairwise_scores(size):
    """Names with and without shared tokens, with shared tokens at both ends and of more than 63 and 200 characters."""
    rng = random.Random(3)
    vocabulary = ["american", "fund", "a", "b", "ab", "ireland", "cab", "x" * 70, "é", "zz", "group", "of", "the", "trust"]
    names = ["", "a", "the the"] + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for _ in range(30)]
    names += [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 60))) for _ in range(8)]
    alphabet = {}
    blocks = [StringBlock(names[i:i + size], [[j] for j in range(i, min(i + size, len(names)))], alphabet) for i in range(0, len(names), size)]
    assert max(len(n) for n in names) > 200
    for m in names:
        for block in blocks:
            got = scores(m, block, alphabet)
            want = [token_set_ratio(m, names[i[0]]) for i in block.idxs]
            assert got.tolist() == want
