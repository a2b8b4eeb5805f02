"""Segmentation and article assembly (W1, A1-A3, P7) including segment edges."""

import random

from conftest import paragraphs_df
from pyspark.sql import functions as F

from presslink.operators import articles
from presslink.operators.articles import assemble_articles, clean_paragraphs, segment, segment_documents


def rows(df):
    return [r.asDict() for r in df.orderBy("path", "seg").collect()]


def test_mocked_document_one_article(spark):
    p = paragraphs_df(spark, [("Test Article Title", "Heading 1", True), ("Source: Test News", "Normal", False),
                              ("Date: 2024-01-15", "Normal", False), ("Article content here.", "Normal", False)])
    [a] = rows(assemble_articles(p))
    assert a["title"] == "Test Article Title"
    assert a["source"] == "Test News" and a["date"] == "2024-01-15"
    assert a["content"] == "Source: Test News\nDate: 2024-01-15\nArticle content here."
    assert a["raw_text"].startswith("Title: Test Article Title\nSource: Test News\nDate: 2024-01-15\nContent: ")


def test_defaults_and_raw_text_before_defaults(spark):
    p = paragraphs_df(spark, [("Test Article Headline", "Heading 1", False), ("Content", "Normal", False)])
    [a] = rows(assemble_articles(p))
    assert a["source"] == "Unknown Source" and a["date"] == "1900-01-01"
    assert a["raw_text"] == "Title: Test Article Headline\nSource: \nDate: \nContent: Content"


def test_segment_edges(spark):
    p = paragraphs_df(spark, [
        ("no title in this segment", "Normal", False), ("End of Document", "Normal", False),     # no title
        ("Lonely Title Here", "Heading 1", False), ("END OF DOCUMENT", "Normal", False),        # title only
        ("   ", "Normal", False),                                                                # blank dropped
        ("Second Story Headline", "Heading 1", False), ("Miami Herald", "Normal", False),
        ("Another Heading Later", "Heading 1", False),                                          # later heading = content
        ("body 2019", "Normal", False), ("end of document", "Normal", False),
        ("Trailing Story Title", "Heading 1", False), ("tail body", "Normal", False)])          # last segment, no boundary
    got = rows(assemble_articles(p))
    assert [a["title"] for a in got] == ["Second Story Headline", "Trailing Story Title"]
    assert got[0]["content"] == "Miami Herald\nAnother Heading Later\nbody 2019"
    assert got[0]["source"] == "Miami Herald" and got[0]["date"] == "2019-01-01"   # last wins (T6)
    assert [a["seg"] for a in got] == [2, 3]


def test_segment_blocks_equal_single_window(spark):
    data = []
    for i in range(200):
        data.append(("Headline Number %d" % i, "Heading 1", False))
        data.append(("text %d" % i, "Normal", False))
        if i % 3 == 0:
            data.append(("End of Document", "Normal", False))
    p = clean_paragraphs(paragraphs_df(spark, data))
    a = {(r.ix, r.seg) for r in segment(p, block=7).collect()}
    b = {(r.ix, r.seg) for r in segment(p, block=1 << 30).collect()}
    assert a == b and max(s for _, s in a) == 67


def test_boundary_count_property(spark):
    data = [("Title %d Story" % i if i % 4 == 0 else "x%d" % i, "Normal", False) for i in range(60)]
    data += [("End of Document", "Normal", False)]
    p = paragraphs_df(spark, data)
    arts = assemble_articles(p).collect()
    assert len(arts) == 1


def test_segment_over_many_blocks_and_groups_of_blocks(spark):
    rows = [("End of Document" if i % 3 == 2 else f"line {i}", "Normal", False) for i in range(2600)]
    p = paragraphs_df(spark, rows).withColumn("ix", F.col("ix") * (1 << 26))     # 2,600 blocks, six groups of blocks
    got = {r.ix >> 26: r.seg for r in segment(p).select("ix", "seg").collect()}
    assert got == {i: i // 3 for i in range(2600) if i % 3 != 2}


def as_documents(p):
    """Paragraphs -> documents of four paragraphs each."""
    return p.groupBy("path", F.expr("ix div 4").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("ix", "text", "style", "first_bold"))).alias("paragraphs"))


def test_segment_documents_equals_segment_of_paragraphs(spark, monkeypatch):
    """Documents with no, one and many boundaries, at both ends; blank paragraphs; several paths; groups of places."""
    rng = random.Random(5)
    texts = ["End of Document", " end of document ", "line", "  ", "other line", "END OF DOCUMENT"]
    a = paragraphs_df(spark, [(rng.choice(texts), "Normal", i % 5 == 0) for i in range(300)], path="a")
    b = paragraphs_df(spark, [(rng.choice(texts[2:5]), "Heading 1", False) for i in range(40)], path="b")
    both = a.unionAll(b)
    want = sorted(map(str, segment(clean_paragraphs(both)).select("path", "ix", "text", "style", "first_bold", "seg").collect()))
    for fan in (1 << 15, 4):
        monkeypatch.setattr(articles, "FAN", fan)
        got = segment_documents(as_documents(both)).select("path", "ix", "text", "style", "first_bold", "seg").collect()
        assert sorted(map(str, got)) == want
    empty = spark.createDataFrame([("a", 0, []), ("a", 1, None)], "path string, pos long, paragraphs "
                                  "array<struct<ix:long,text:string,style:string,first_bold:boolean>>")
    assert segment_documents(empty).collect() == [] and segment_documents(empty.limit(0)).collect() == []
