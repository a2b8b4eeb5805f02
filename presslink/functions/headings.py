"""Heading classifier (P6): skip phrases, then style, then bold, then title shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslink.functions.text import cached_column, col_, split_words

# Phrases that mark a paragraph as metadata, never a title.
SKIP_PHRASES = [
    "byline:", "copyright", "end of document", "source:", "publication:",
    "dateline:", "length:", "word count:", "load-date:", "language:",
]
# Openings that disqualify a bold paragraph.
BOLD_EXCLUDED_PREFIXES = ["By ", "From ", "Published ", "Updated "]
# Openings and endings that disqualify a title-shaped paragraph.
TITLE_EXCLUDED_PREFIXES = ["The ", "A ", "An ", "In ", "On ", "At ", "By ", "From "]
TITLE_EXCLUDED_SUFFIXES = [":", ";", ","]


def _any(cs) -> Column:
    return reduce(lambda a, b: a | b, cs)


@cached_column
def is_heading(text, style, first_bold) -> Column:
    """Boolean heading flag of an already stripped, non-empty paragraph."""
    t, st, bold = col_(text), col_(style), col_(first_bold)
    low = F.lower(t)
    n = F.length(t)
    skip = _any([low.contains(p) for p in SKIP_PHRASES])
    styled = F.coalesce(F.lower(st).contains("heading"), F.lit(False))
    bold_rule = (
        F.coalesce(bold, F.lit(False)) & n.between(10, 200)
        & ~_any([t.startswith(p) for p in BOLD_EXCLUDED_PREFIXES])
    )
    capitalised = F.size(F.filter(split_words(t), lambda w: w.rlike(r"^\p{IsUppercase}")))
    title_like = (
        n.between(10, 150)
        & ~_any([t.startswith(p) for p in TITLE_EXCLUDED_PREFIXES])
        & ~_any([t.endswith(p) for p in TITLE_EXCLUDED_SUFFIXES])
        & (capitalised >= 2)
    )
    return (t != "") & ~skip & (styled | bold_rule | title_like)
