"""Organisation-name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslink.functions.text import cached_column, col_, strip

# Python's word characters: letters, numbers, underscore; combining marks are none (Java's Unicode word class has them).
W = r"\p{L}\p{N}_"
# Corporate suffix words removed before matching; only the dotted one ends in no word character.
SUFFIX_WORDS = "incorporated|inc|llc|ltd|co|corp|corporation|plc"
SUFFIX_DOTTED = r"l\.l\.c\."


@cached_column
def normalize_name(c) -> Column:
    """lower → drop suffix words → punctuation to space → collapse spaces → strip."""
    s = F.lower(F.coalesce(col_(c), F.lit("")))
    s = F.regexp_replace(s, rf"(?<![{W}])(?:(?:{SUFFIX_WORDS})(?![{W}])|{SUFFIX_DOTTED}(?=[{W}]))", "")
    s = F.regexp_replace(s, rf"(?U)[^{W}\s]", " ")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return strip(s)
