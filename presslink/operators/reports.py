"""Flatten, aggregate and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def citation(source, title) -> Column:
    """``"source", "title"``."""
    s = F.col(source) if isinstance(source, str) else source
    t = F.col(title) if isinstance(title, str) else title
    return F.concat(F.lit('"'), s, F.lit('", "'), t, F.lit('"'))


def explode_mentions(analyses: DataFrame) -> DataFrame:
    """One row per kept mention; articles without mentions vanish."""
    return analyses.select(
        "path", "seg",
        citation("publication_source", "article_title").alias("citation"),
        F.col("publication_date").alias("date"),
        F.posexplode("company_mentions").alias("pos", "m"),
    ).select("path", "seg", F.col("pos").cast("long").alias("pos"), "citation", "date",
             F.col("m.company_name").alias("company_name"), F.col("m.description").alias("description"))


def summary_totals(analyses: DataFrame) -> DataFrame:
    """A5: articles, articles with mentions, mentions (one partial-aggregated pass)."""
    n = F.size("company_mentions")
    return analyses.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_if(n > 0).alias("articles_with_mentions"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_mentions"),
    )


def unique_companies(analyses: DataFrame) -> DataFrame:
    """Distinct lower-cased names (distinct via a shuffle on the name, not the driver)."""
    names = analyses.select(F.explode("company_mentions").alias("m")).select(
        F.lower(F.col("m.company_name")).alias("name"))
    return names.agg(F.count_distinct("name").alias("unique_companies"))


def publication_breakdown(analyses: DataFrame) -> DataFrame:
    """Articles and mentions per exact source, zero-mention sources kept."""
    return analyses.groupBy(F.col("publication_source").alias("publication")).agg(
        F.count(F.lit(1)).alias("articles"),
        F.sum(F.size("company_mentions")).cast("long").alias("total_mentions"),
    )


def _csv_field(c: Column) -> Column:
    """CSV quoting of one field (quote when it holds a comma, quote, or line break)."""
    s = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.rlike('[",\r\n]'), quoted).otherwise(s)


def summary_report(analyses: DataFrame) -> DataFrame:
    """Totals and the per-publication breakdown as one long table
    ``(ord, key, line)``; each line is one CSV row of the summary file and the
    file order is ``(ord, key)`` (a distributed sort, no single-task window)."""
    t = summary_totals(analyses)
    def row(o: int, line) -> Column:
        return F.struct(F.lit(o).alias("ord"), (F.lit(line) if isinstance(line, str) else line).alias("line"))

    def stat(o: int, label: str, c: str) -> Column:
        return row(o, F.concat(F.lit(label + ","), F.col(c).cast("string")))

    head = t.select(F.inline(F.array(
        row(0, "Summary Statistics"),
        stat(1, "Total Articles Processed", "total_articles"),
        stat(2, "Articles with Company Mentions", "articles_with_mentions"),
        stat(3, "Total Company Mentions", "total_mentions"),
        row(5, ""),
        row(6, "Publication Breakdown"),
        row(7, "Publication,Articles,Total Mentions"),
    )))
    uniq = unique_companies(analyses).select(
        F.lit(4).alias("ord"),
        F.concat(F.lit("Unique Companies Mentioned,"), F.col("unique_companies").cast("string")).alias("line"))
    pubs = publication_breakdown(analyses).select(
        F.lit(8).alias("ord"), F.col("publication").alias("key"),
        F.concat_ws(",", _csv_field(F.col("publication")), F.col("articles").cast("string"),
                    F.col("total_mentions").cast("string")).alias("line"))
    fixed = head.unionByName(uniq).select(F.col("ord").cast("long").alias("ord"), F.lit("").alias("key"), "line")
    return fixed.unionByName(pubs.select(F.col("ord").cast("long").alias("ord"), "key", "line"))
