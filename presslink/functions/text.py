"""Whitespace, boundary and character-set helpers."""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` / ``str.split()`` treat as
# whitespace (str.isspace), so trimming matches the rules' meaning exactly.
WS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java regex class equal to the set above (used for splitting into words).
WS_CLASS = r"[\s\x1c-\x1f]"

BOUNDARY = "end of document"


def cached_column(fn):
    """Memoise a rule built from column *names* (Columns are reusable expression trees;
    building a large one costs many JVM round trips). Keyed by the running context."""
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        if not all(isinstance(a, (str, int)) for a in args):
            return fn(*args)
        context = SparkContext._active_spark_context
        key = (context.applicationId if context is not None else None, args)
        col = cache.get(key)
        if col is None:
            col = cache[key] = fn(*args)
        return col
    return wrapper


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """``str.strip()``: remove all Unicode whitespace at both ends (not only spaces)."""
    return F.btrim(col_(c), F.lit(WS))


def nonblank(c) -> Column:
    """Strip, then turn an empty result into NULL (Python's falsy empty string)."""
    return F.nullif(strip(c), F.lit(""))


def is_boundary(text) -> Column:
    """Article boundary: the whole (stripped) paragraph is ``end of document``, any case."""
    return F.lower(col_(text)) == F.lit(BOUNDARY)


def split_words(text) -> Column:
    """``str.split()`` on an already stripped string."""
    return F.split(col_(text), "(?U)" + WS_CLASS + "+")
