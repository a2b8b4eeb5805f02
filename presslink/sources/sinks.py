"""Writers. Each output is globally ordered by an explicit key and written
by Spark in parallel (range-partitioned sort, part files in key order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MENTION_HEADERS = ["Citations", "Date", "Company/Organization Name", "Description"]


def write_mentions(exploded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Mention rows (X1 output) as CSV with a header, quoted RFC-4180 style."""
    (exploded.orderBy("path", "seg", "pos")
     .select(F.col("citation").alias(MENTION_HEADERS[0]), F.col("date").alias(MENTION_HEADERS[1]),
             F.col("company_name").alias(MENTION_HEADERS[2]), F.col("description").alias(MENTION_HEADERS[3]))
     .write.mode(mode).option("header", "true").option("escape", '"').option("emptyValue", "")
     .csv(path))


def write_summary(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The A8 long table as the two-section summary file (lines already CSV)."""
    report.orderBy("ord", "key").select("line").write.mode(mode).text(path)


def write_match_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Match report lines in mention order."""
    order = ["mention_id", "line_no"]
    if "source_file" in lines.columns:
        order = ["source_file"] + order
    lines.orderBy(*order).select("line").write.mode(mode).text(path)
