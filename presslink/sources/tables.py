"""S3/S4 projections shared by the CSV readers and table inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslink.functions.text import strip


def read_mentions_table(df: DataFrame, id_col: str = "mention_id", name_col: str = "name") -> DataFrame:
    """S3 rules: strip names, drop blanks, keep order key and duplicates."""
    return (df.select(F.col(id_col).alias("mention_id"), strip(F.coalesce(F.col(name_col), F.lit(""))).alias("name"))
            .filter(F.col("name") != ""))


def read_contributions_table(df: DataFrame, idx_col: str = "idx", name_col: str = "contributor_name",
                             employer_col: str = "contributor_employer") -> DataFrame:
    """S4 rules: only the two fields, missing -> '', stripped; ``idx`` kept as identity."""
    return df.select(
        F.col(idx_col).alias("idx"),
        strip(F.coalesce(F.col(name_col), F.lit(""))).alias("contributor_name"),
        strip(F.coalesce(F.col(employer_col), F.lit(""))).alias("contributor_employer"))
