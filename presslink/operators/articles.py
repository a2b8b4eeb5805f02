"""Paragraphs -> segments -> articles.

A paragraph relation has ``path, ix, text, style, first_bold``; ``ix`` orders
paragraphs inside one ``path``. Article boundaries are ``end of document``
paragraphs; every segment between two boundaries yields at most one article.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslink.functions import extract_date, extract_source, is_boundary, is_heading, strip

DEFAULT_SOURCE = "Unknown Source"
DEFAULT_DATE = "1900-01-01"
# Paragraph positions per prefix-sum block: bounds the rows one window task sorts.
DEFAULT_BLOCK = 1 << 20
#: Blocks (or groups of blocks) per group in the running count of boundaries: the rows one window sorts.
FAN = 1 << 15


def clean_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Strip every paragraph, drop the empty ones."""
    return paragraphs.withColumn("text", strip("text")).filter(F.col("text") != "")


def mark_boundaries(paragraphs: DataFrame) -> DataFrame:
    """Flag boundary paragraphs (input already cleaned)."""
    return paragraphs.withColumn("is_boundary", is_boundary("text"))


def _before(col: str, w) -> Column:
    """Sum of ``col`` over the rows before this one."""
    return F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _running(counts: DataFrame, levels: int) -> DataFrame:
    """``path, _blk, _n`` -> ``path, _blk, _off``: the total of the path's earlier blocks.

    Each level adds up ``FAN`` neighbours, so a window never holds more than ``FAN`` rows.
    """
    if levels == 0:
        return counts.select("path", "_blk", _before("_n", Window.partitionBy("path").orderBy("_blk")).alias("_off"))
    fine = counts.withColumn("_up", F.expr(f"_blk div {FAN}"))
    groups = fine.groupBy("path", "_up").agg(F.sum("_n").alias("_n")).withColumnRenamed("_up", "_blk")
    above = _running(groups, levels - 1).select("path", F.col("_blk").alias("_up"), F.col("_off").alias("_base"))
    inside = fine.withColumn("_in", _before("_n", Window.partitionBy("path", "_up").orderBy("_blk")))
    return inside.join(above, ["path", "_up"], "inner").select(
        "path", "_blk", (F.col("_base") + F.col("_in")).alias("_off"))


def segment(paragraphs: DataFrame, block: int | None = DEFAULT_BLOCK) -> DataFrame:
    """``seg`` = number of boundaries at or before each paragraph in its path;
    boundary rows are removed.

    The running count is a prefix sum in levels so a path holding a large share
    of all rows never lands in one task: boundaries are counted per
    ``(path, ix div block)``, those counts get a running total inside groups of
    ``FAN`` blocks, the groups inside groups of groups, with enough levels for any
    long ``ix`` (so no window grows with the data), and each block only sorts its
    own rows. The block counts need their own pass
    over the input (an exact prefix sum is two-pass); it aggregates map-side, so
    only partial counts are shuffled. ``block=None`` gives the single-window form
    for inputs whose paths are bounded (one Word file each).
    """
    b = is_boundary("text").cast("int")
    if block is None:
        # Each path is small (one Word file): a plain running count per path.
        w = Window.partitionBy("path").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
        return (paragraphs.withColumn("_b", b).withColumn("seg", F.sum("_b").over(w).cast("long"))
                .filter(F.col("_b") == 0).drop("_b"))
    df = paragraphs.withColumn("_b", b).withColumn("_blk", F.expr(f"ix div {int(block)}"))
    # Block counts: partial (map-side) aggregation, so only one small count per
    # (path, block) and input split is shuffled.
    per_block = df.groupBy("path", "_blk").agg(F.sum("_b").alias("_n"))
    bits = 63 - int(math.log2(block))
    offsets = _running(per_block, max(0, math.ceil(bits / int(math.log2(FAN))) - 1))
    local = F.sum("_b").over(
        Window.partitionBy("path", "_blk").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_local", local)
        .join(offsets, ["path", "_blk"], "inner")
        .withColumn("seg", (F.col("_off") + F.col("_local")).cast("long"))
        .filter(F.col("_b") == 0)
        .drop("_b", "_blk", "_local", "_off")
    )


def segment_documents(documents: DataFrame) -> DataFrame:
    """W1 for paths made of many documents: ``path, pos, paragraphs`` -> ``path, ix, text, style, first_bold, seg``.

    ``paragraphs`` is a document's array of ``ix, text, style, first_bold`` in order, ``pos`` (not negative, once per
    path) orders the documents of a path. Paragraphs are cleaned (P1) and boundaries counted inside the arrays, the
    running count goes over documents (one small row each, in groups of ``FAN`` places), and each array is opened
    once, with ``seg`` known: no paragraph is shuffled or sorted.
    """
    cleaned = documents.select("path", "pos", F.filter(
        F.transform("paragraphs", lambda p: F.struct(p["ix"].alias("ix"), strip(p["text"]).alias("text"), p["style"].alias("style"),
                                                     p["first_bold"].alias("first_bold"))),
        lambda p: p["text"] != "").alias("_p"))
    counts = documents.select("path", F.col("pos").alias("_blk"), F.size(
        F.filter("paragraphs", lambda p: is_boundary(strip(p["text"])))).alias("_n"))
    last = documents.agg(F.max("pos")).first()[0] or 0
    offsets = _running(counts, max(0, math.ceil(last.bit_length() / int(math.log2(FAN))) - 1)).withColumnRenamed("_blk", "pos")
    with_ends = cleaned.join(offsets, ["path", "pos"]).withColumn("_ends", F.filter(
        F.transform("_p", lambda p, i: F.when(is_boundary(p["text"]), i)), lambda i: i.isNotNull()))

    def segment_of(j):
        """The paragraphs between two boundaries, with the number of boundaries before them."""
        first = F.when(j == 0, F.lit(0)).otherwise(F.get("_ends", j - 1) + 1)
        stop = F.coalesce(F.get("_ends", j), F.size("_p"))
        return F.transform(F.slice("_p", first + 1, stop - first), lambda p: F.struct(
            p["ix"].alias("ix"), p["text"].alias("text"), p["style"].alias("style"), p["first_bold"].alias("first_bold"),
            (F.col("_off") + j).cast("long").alias("seg")))

    return with_ends.select("path", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_ends")), segment_of))))


def annotate_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Per-paragraph rule results (heading flag, source, date) feeding the segment
    aggregate. Applied before segmentation so the regex work runs in the input stage."""
    if "is_heading" in paragraphs.columns:
        return paragraphs
    return paragraphs.select(
        "*", is_heading("text", "style", "first_bold").alias("is_heading"),
        extract_source("text").alias("src"), extract_date("text").alias("dt"))


def segment_summary(segmented: DataFrame) -> DataFrame:
    """A1-A3 in one aggregate per ``(path, seg)``.

    title   = first heading (A1); source/date = last non-empty extraction (A2);
    content = every other paragraph in order, newline-joined (A3).
    """
    p = annotate_paragraphs(segmented)
    agg = p.groupBy("path", "seg").agg(
        F.min(F.when(F.col("is_heading"), F.col("ix"))).alias("title_ix"),
        F.min_by("text", F.when(F.col("is_heading"), F.col("ix"))).alias("title"),
        F.max_by("src", F.when(F.col("src").isNotNull(), F.col("ix"))).alias("source"),
        F.max_by("dt", F.when(F.col("dt").isNotNull(), F.col("ix"))).alias("date"),
        F.count(F.lit(1)).alias("_n"),
        F.collect_list(F.struct("ix", "text")).alias("_parts"),
    )
    parts = F.array_sort(F.filter("_parts", lambda x: F.col("title_ix").isNull() | (x["ix"] != F.col("title_ix"))))
    return agg.select(
        "path", "seg", "title_ix", "title", "source", "date",
        # by count, so that the texts are not collected where the content is not asked for
        (F.col("_n") - F.col("title_ix").isNotNull().cast("int")).cast("int").alias("n_parts"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("content"))


def build_articles(summary: DataFrame, default_source: str = DEFAULT_SOURCE,
                   default_date: str = DEFAULT_DATE) -> DataFrame:
    """Keep segments with a title and at least one content paragraph; ``raw_text``
    shows the undefaulted source/date; then apply defaults and strip (T8)."""
    src = F.coalesce(F.col("source"), F.lit(""))
    dt = F.coalesce(F.col("date"), F.lit(""))
    raw = F.concat(F.lit("Title: "), F.col("title"), F.lit("\nSource: "), src, F.lit("\nDate: "), dt,
                   F.lit("\nContent: "), F.col("content"))
    return (
        summary.filter(F.col("title").isNotNull() & (F.col("n_parts") > 0))
        .select(
            "path", "seg",
            strip("title").alias("title"),
            strip(F.coalesce(F.nullif(src, F.lit("")), F.lit(default_source))).alias("source"),
            strip(F.coalesce(F.nullif(dt, F.lit("")), F.lit(default_date))).alias("date"),
            strip("content").alias("content"),
            strip(raw).alias("raw_text"),
        )
    )


def assemble_articles(paragraphs: DataFrame, default_source: str = DEFAULT_SOURCE,
                      default_date: str = DEFAULT_DATE, block: int | None = DEFAULT_BLOCK) -> DataFrame:
    """Raw paragraphs -> articles ``(path, seg, title, source, date, content, raw_text)``."""
    seg = segment(annotate_paragraphs(clean_paragraphs(paragraphs)), block=block)
    return build_articles(segment_summary(seg), default_source, default_date)
