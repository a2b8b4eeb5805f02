"""Flatten / summary / CSV export (P13, X1, A5-A8, S5, S6) with the exporter's test values."""

import csv
import glob
import os

from presslink.operators import reports as rpt
from presslink.sources import sinks

SCHEMA = ("path string, seg long, article_title string, publication_source string, publication_date string, "
          "company_mentions array<struct<company_name:string,description:string>>")


def analyses(spark):
    return spark.createDataFrame([
        ("p", 0, "Article 1", "Publication A", "2024-01-15", [("Company A", "Desc A, with comma"),
                                                              ("Company B", 'Says "hi"')]),
        ("p", 1, "Article 2", "Publication A", "2024-01-16", [("company a", "Again")]),
        ("p", 2, "Article 3", "Publication B", "2024-01-17", []),
    ], SCHEMA)


def test_totals_and_breakdown(spark):
    a = analyses(spark)
    t = rpt.summary_totals(a).first()
    assert (t.total_articles, t.articles_with_mentions, t.total_mentions) == (3, 2, 3)
    assert rpt.unique_companies(a).first().unique_companies == 2
    b = {r.publication: (r.articles, r.total_mentions) for r in rpt.publication_breakdown(a).collect()}
    assert b == {"Publication A": (2, 3), "Publication B": (1, 0)}


def test_explode_and_citation(spark):
    rows = rpt.explode_mentions(analyses(spark)).orderBy("seg", "pos").collect()
    assert len(rows) == 3
    assert rows[0].citation == '"Publication A", "Article 1"'
    assert [r.company_name for r in rows] == ["Company A", "Company B", "company a"]


def test_write_mentions_round_trip(spark, tmp_path):
    out = str(tmp_path / "mentions")
    sinks.write_mentions(rpt.explode_mentions(analyses(spark)), out)
    rows = []
    for f in sorted(glob.glob(os.path.join(out, "part-*.csv"))):
        with open(f, newline="", encoding="utf-8") as fh:
            rows += list(csv.DictReader(fh))
    assert [r["Company/Organization Name"] for r in rows] == ["Company A", "Company B", "company a"]
    assert rows[0]["Description"] == "Desc A, with comma" and rows[1]["Description"] == 'Says "hi"'
    assert rows[0]["Citations"] == '"Publication A", "Article 1"'


def test_summary_file(spark, tmp_path):
    out = str(tmp_path / "summary")
    sinks.write_summary(rpt.summary_report(analyses(spark)), out)
    lines = []
    for f in sorted(glob.glob(os.path.join(out, "part-*"))):
        lines += open(f, encoding="utf-8").read().splitlines()
    assert lines == ["Summary Statistics", "Total Articles Processed,3", "Articles with Company Mentions,2",
                     "Total Company Mentions,3", "Unique Companies Mentioned,2", "", "Publication Breakdown",
                     "Publication,Articles,Total Mentions", "Publication A,2,3", "Publication B,1,0"]


def test_summary_quotes_publication_with_comma(spark):
    a = spark.createDataFrame([("p", 0, "T", 'Daily, "The" Post', "2024-01-01", [("X", "d")])], SCHEMA)
    lines = [r.line for r in rpt.summary_report(a).orderBy("ord", "key").collect()]
    assert lines[-1] == '"Daily, ""The"" Post",1,1'
