"""Paragraphs from any text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paragraphs_from_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per ``\\n``-separated line: ``path`` (the id as text), ``ix`` (line number),
    ``text``; plain style and no bold, so the article rules run on any text table."""
    return df.select(
        F.col(id_col).cast("string").alias("path"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("ix", "text"),
    ).select(
        "path", F.col("ix").cast("long").alias("ix"), "text",
        F.lit("Normal").alias("style"), F.lit(False).alias("first_bold"),
    )
