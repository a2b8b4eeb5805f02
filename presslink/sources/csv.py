"""CSV readers for mention and contribution files.

Files are read in splits (``quoted.py``), so embedded quotes and line breaks round-trip
(T16) and a large file is many tasks. Row identity is file order (T20): files by name,
rows as they stand in the file, numbered from 0 over all files. All files must have the
same header: one whose columns stand in another order is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslink.functions.text import strip
from presslink.sources.quoted import read_quoted
from presslink.sources.tables import read_contributions_table

MENTION_COLUMN = "Company/Organization Name"
CONTRIBUTOR_NAME = "Contributor Name"
CONTRIBUTOR_EMPLOYER = "Contributor Employer"


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """``mention_id, name, source_file``: names stripped, blanks dropped, duplicates kept."""
    df = read_quoted(spark, path, [MENTION_COLUMN])
    return (df.select(F.col("_row").alias("mention_id"), strip(F.coalesce(F.col(f"`{MENTION_COLUMN}`"), F.lit("")))
                      .alias("name"), "source_file")
            .filter(F.col("name") != ""))


def read_contributions(spark: SparkSession, path: str) -> DataFrame:
    """``idx, contributor_name, contributor_employer``; only the two fields are read."""
    df = read_quoted(spark, path, [CONTRIBUTOR_NAME, CONTRIBUTOR_EMPLOYER])
    return read_contributions_table(df, "_row", f"`{CONTRIBUTOR_NAME}`", f"`{CONTRIBUTOR_EMPLOYER}`")


def contributions_to_table(spark: SparkSession, csv_path: str, out_path: str) -> DataFrame:
    """Convert contribution CSV files once to Parquet, keeping ``idx`` (file order) and
    ``source_file``, then read the table back: later jobs need not parse it again."""
    df = read_quoted(spark, csv_path, [CONTRIBUTOR_NAME, CONTRIBUTOR_EMPLOYER])
    (df.select(
        F.col("_row").alias("idx"),
        strip(F.coalesce(F.col(f"`{CONTRIBUTOR_NAME}`"), F.lit(""))).alias("contributor_name"),
        strip(F.coalesce(F.col(f"`{CONTRIBUTOR_EMPLOYER}`"), F.lit(""))).alias("contributor_employer"),
        "source_file")
     .write.mode("overwrite").parquet(out_path))
    return spark.read.parquet(out_path)
