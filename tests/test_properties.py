"""Property checks: scorer laws, top-k size, report consistency, segment counts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presslink.functions.similarity import lcs_length, token_set_ratio
from presslink.plans import catalog

WORDS = st.text(alphabet="abcde", min_size=1, max_size=6)
NAMES = st.lists(WORDS, min_size=0, max_size=4).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(NAMES, NAMES)
def test_token_set_ratio_laws(a, b):
    s = token_set_ratio(a, b)
    assert 0.0 <= s <= 100.0
    assert s == token_set_ratio(b, a)
    if a.split() and set(a.split()) <= set(b.split()):
        assert s == 100.0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abc", max_size=40))
def test_lcs_laws(a, b):
    n = lcs_length(a, b)
    assert n == lcs_length(b, a) and 0 <= n <= min(len(a), len(b))
    assert lcs_length(a, a) == len(a)


SF = "/root/testdata/sf0.001"


def test_totals_equal_breakdown_sums(spark):
    t = catalog.QUERIES["summary_totals"](spark, SF).first()
    b = catalog.QUERIES["publication_breakdown"](spark, SF).agg(
        F.sum("articles").alias("a"), F.sum("total_mentions").alias("m")).first()
    assert (t.total_articles, t.total_mentions) == (b.a, b.m)
    assert t.articles_with_mentions <= t.total_articles


def test_articles_at_most_one_per_segment(spark):
    arts = catalog.QUERIES["build_articles"](spark, SF)
    segs = catalog.QUERIES["segment_content"](spark, SF)
    assert arts.count() == arts.select("path", "seg").distinct().count() <= segs.count()
    # every article's segment has a title and content
    ok = segs.filter(F.col("n_parts") > 0).join(catalog.QUERIES["segment_titles"](spark, SF), ["path", "seg"])
    assert ok.count() == arts.count()


def test_topk_sizes(spark):
    top = catalog.QUERIES["topk_names"](spark, SF)
    per = top.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("r"))
    assert per.filter((F.col("n") > 5) | (F.col("r") != F.col("n"))).count() == 0
    ranked = catalog.QUERIES["rank_candidates"](spark, SF)
    assert ranked.groupBy("mention_id").count().filter(F.col("count") > 10).count() == 0
