"""Paragraph rules: the reference's date/source/extraction tables plus Unicode cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from presslink.functions import extract_date, extract_source, is_heading, normalize_date, normalize_name, strip
from presslink.options import Options, valid_date_option
from presslink.plans import oracle


def one(spark, col_fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(col_fn(F.col("v"))).collect()]


def test_normalize_date_formats(spark):
    cases = [("2024-01-15", "2024-01-15"), ("1/15/2024", "2024-01-15"), ("01-15-2024", "2024-01-15"),
             ("January 15, 2024", "2024-01-15"), ("Jan 15, 2024", "2024-01-15"), ("15 January 2024", "2024-01-15"),
             ("January 2024", "2024-01-01"), ("Jan 2024", "2024-01-01"), ("2024", "2024-01-01")]
    assert one(spark, normalize_date, [c[0] for c in cases]) == [c[1] for c in cases]


def test_normalize_date_unknown_kept(spark):
    assert one(spark, normalize_date, [" Someday 2024 ", "13/45/2024", "Sept 5, 2024"]) == [
        "Someday 2024", "2024-13-45", "Sept 5, 2024"]


def test_extract_source_patterns(spark):
    cases = [("The Miami Herald - Company Reports", "The Miami Herald"),
             ("Source: Reuters News Service", "Reuters News Service"),
             ("Publication: Financial Times", "Financial Times"),
             ("Copyright 2024 The Miami Herald", "The Miami Herald"),
             ("Miami Herald", "Miami Herald"),
             ("The Wall Street Journal", "The Wall Street Journal"),
             ("Regular text without source", None)]
    assert one(spark, extract_source, [c[0] for c in cases]) == [c[1] for c in cases]


def test_extract_source_case_insensitive_trap(spark):
    # IGNORECASE lets [A-Z] match lower case: a plain sentence ending in "news" is a source.
    assert one(spark, extract_source, ["officials said the news"]) == ["officials said the news"]


def test_extract_date_patterns(spark):
    cases = [("Published on 2024-01-15", "2024-01-15"), ("Date: January 15, 2024", "2024-01-15"),
             ("March 2024 report", "2024-03-01"), ("Published: 1/15/2024", "2024-01-15"),
             ("Load-Date: January 15, 2024", "2024-01-15"), ("Text without date", None),
             ("Sept 5, 2024", "2024-01-01"), ("12345", "1234-01-01"),
             ("Load-Date: March 3, 2021 (updated 2/2/2020)", "2020-02-02")]
    assert one(spark, extract_date, [c[0] for c in cases]) == [c[1] for c in cases]


def test_unicode_digits_and_whitespace(spark):
    # Python's \d is Unicode: Arabic-Indic digits form a year; strip removes NBSP and ideographic space.
    assert one(spark, extract_date, ["year ٢٠٢٤"]) == ["٢٠٢٤-01-01"]
    assert one(spark, strip, [" 　 text \n"]) == ["text"]


def test_heading_rules(spark):
    rows = [("Test Article Title", "Heading 1", True, True),
            ("Byline: Someone Important", "Heading 1", True, False),      # skip phrase first
            ("quiet lowercase words here", "Normal", False, False),
            ("quiet lowercase words here", "Normal", True, True),         # bold rule
            ("By Staff Writer Here", "Normal", True, False),              # bold excluded prefix
            ("Date: January 15, 2024", "Normal", False, True),            # metadata line looks like a title (T7)
            ("The Quick Brown Fox", "Normal", False, False),              # excluded opening
            ("Council Approves Budget:", "Normal", False, False),         # excluded ending
            ("Short Ti", "Normal", False, False),                         # too short
            ("Émile Zola Écrit", None, None, True)]                       # Unicode upper case, null style
    df = spark.createDataFrame([r[:3] for r in rows], "t string, s string, b boolean")
    got = [r[0] for r in df.select(is_heading("t", "s", "b")).collect()]
    assert got == [r[3] for r in rows]


def test_normalize_name(spark):
    cases = [("Acme, Inc.", "acme"), ("Foo L.L.C.", "foo l l c"), ("Co-op Bank", "op bank"),
             ("ACME   Widgets LLC", "acme widgets"), ("snake_case Corp", "snake_case"), (None, ""),
             ("Caf\u00e9 Inc", "caf\u00e9"), ("Cafe\u0301 Inc", "cafe"), ("\u00e9inc", "\u00e9inc"), ("l.l.c.x y.l.l.c. z", "x y l l c z"),
             ("x\u0301inc \u00b2co", "x \u00b2co"), ("Inc inc", "")]
    assert one(spark, normalize_name, [c[0] for c in cases]) == [c[1] for c in cases]
    sql = "SELECT " + ", ".join(oracle.normalize_name("NULL" if c[0] is None else f"'{c[0]}'") for c in cases)
    assert duckdb.sql(sql).fetchall()[0] == tuple(c[1] for c in cases)


def test_date_option_validity():
    assert valid_date_option("2020-01-01") and valid_date_option("2020-1-1")
    for bad in ["2020-13-01", "2020/01/01", ""]:
        assert not valid_date_option(bad)
    with pytest.raises(ValueError):
        Options(default_date="2020/01/01")
