"""Publication-source extraction (P3): first matching pattern wins, group 1 stripped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslink.functions.text import cached_column, col_, nonblank

# The source patterns, in priority order. They are matched
# case-insensitively with ^ at every line start; Python's Unicode classes
# are kept through Java's UNICODE_CHARACTER_CLASS flag and UNIX_LINES
# makes ^ follow only "\n", like Python.
SOURCE_PATTERNS = [
    # copyright notice
    r"Copyright\s+\d{4}[^\n\r]*?([A-Z][a-zA-Z\s&.]+(?:News|Times|Post|Journal|Tribune|Herald|Globe|Daily|Weekly|Magazine|Review|Report|Wire|Press|Today|Business|Financial|Economic|Market|Trade|Industry|Technology|Tech|Online|Digital|Network|Media|Broadcasting|Television|TV|Radio|Reuters|Bloomberg|Associated Press|AP|CNN|BBC|NPR|Wall Street|Financial Times|FT|Chronicle|Gazette|Bulletin|Record|Examiner|Standard))",
    # "The ..." publication name at a line start
    r"^(The\s+[A-Z][a-zA-Z\s]+(?:Herald|Times|Post|Journal|Tribune|Globe|Daily|News|Weekly|Magazine|Review|Report|Wire|Press|Today|Business|Chronicle|Gazette|Bulletin|Record|Examiner|Standard))",
    # publication name without "The"
    r"^([A-Z][a-zA-Z\s]+(?:Herald|Times|Post|Journal|Tribune|Globe|Daily|News|Weekly|Magazine|Review|Report|Wire|Press|Today|Business|Chronicle|Gazette|Bulletin|Record|Examiner|Standard))",
    # explicit labels
    r"Source:\s*([^\n\r]+)",
    r"Publication:\s*([^\n\r]+)",
    # name followed by a dash
    r"^([A-Z][a-zA-Z\s&]+(?:Herald|Times|Post|Journal|Tribune|Globe|Daily|News)) -",
    # well-known outlets
    r"\b(Reuters|Bloomberg|Associated Press|AP News|CNN|BBC|NPR|Wall Street Journal|Financial Times|USA Today|Washington Post|New York Times|Miami Herald|Sun Sentinel)\b",
]

SOURCE_FLAGS = "(?imdU)"

# Literals every source pattern requires (lower case). A paragraph
# containing none of them cannot match any pattern, so the cascade is skipped.
# Outlet names already covered by a suffix word (e.g. "times", "post") are omitted.
SOURCE_KEYWORDS = [
    "copyright", "source:", "publication:",
    "herald", "times", "post", "journal", "tribune", "globe", "daily", "news", "weekly", "magazine", "review",
    "report", "wire", "press", "today", "business", "chronicle", "gazette", "bulletin", "record", "examiner",
    "standard",
    "reuters", "bloomberg", "cnn", "bbc", "npr", "sun sentinel",
]
# Characters that case-insensitive Unicode matching equates with ASCII letters
# (dotless/dotted i, long s, Kelvin sign), folded before the keyword test.
_FOLD_FROM, _FOLD_TO = "\u0131\u0130\u017f\u212a", "iisk"


def source_guard(text) -> Column:
    """Cheap exact pre-test: false means no source pattern can match."""
    folded = F.lower(F.translate(col_(text), _FOLD_FROM, _FOLD_TO))
    return reduce(lambda a, b: a | b, [folded.contains(k) for k in SOURCE_KEYWORDS])


@cached_column
def extract_source(text) -> Column:
    """NULL when no pattern matches; ``coalesce`` stops at the first hit (T4)."""
    t = col_(text)
    cascade = F.coalesce(*[nonblank(F.regexp_extract(t, SOURCE_FLAGS + p, 1)) for p in SOURCE_PATTERNS])
    return F.when(source_guard(t), cascade)
