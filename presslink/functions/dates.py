"""Publication-date extraction (P4) and normalisation to ``YYYY-MM-DD`` (P5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslink.functions.text import cached_column, col_, nonblank, strip

_FULL = "January|February|March|April|May|June|July|August|September|October|November|December"
_ABBR = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

# Date patterns in priority order (ISO, slash, dash, labelled,
# month names, month-year, bare year), matched case-insensitively.
DATE_PATTERNS = [
    r"(\d{4}-\d{2}-\d{2})",
    r"(\d{1,2}/\d{1,2}/\d{4})",
    r"(\d{1,2}-\d{1,2}-\d{4})",
    r"Published:\s*(\d{1,2}/\d{1,2}/\d{4})",
    r"Published:\s*((?:" + _FULL + r")\s+\d{1,2},?\s+\d{4})",
    r"Load-Date:\s*(\d{1,2}/\d{1,2}/\d{4})",
    r"Load-Date:\s*((?:" + _FULL + r")\s+\d{1,2},?\s+\d{4})",
    r"((?:" + _FULL + r")\s+\d{1,2},?\s+\d{4})",
    r"((?:" + _ABBR + r")\s+\d{1,2},?\s+\d{4})",
    r"(\d{1,2}\s+(?:" + _FULL + r")\s+\d{4})",
    r"((?:" + _FULL + r")\s+\d{4})",
    r"((?:" + _ABBR + r")\s+\d{4})",
    r"(\d{4})",
]

DATE_FLAGS = "(?iU)"

# Month names and abbreviations to month numbers.
MONTHS = {
    "january": "01", "february": "02", "march": "03", "april": "04",
    "may": "05", "june": "06", "july": "07", "august": "08",
    "september": "09", "october": "10", "november": "11", "december": "12",
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}

# Whole-string shapes tried by the normaliser, in order.
_ISO = r"(?U)^\d{4}-\d{2}-\d{2}$"
_MDY_SLASH = r"(?U)^(\d{1,2})/(\d{1,2})/(\d{4})$"
_MDY_DASH = r"(?U)^(\d{1,2})-(\d{1,2})-(\d{4})$"
_NAME_D_Y = r"(?iU)^(\w+)\s+(\d{1,2}),?\s+(\d{4})$"
_D_NAME_Y = r"(?iU)^(\d{1,2})\s+(\w+)\s+(\d{4})$"
_NAME_Y = r"(?iU)^(\w+)\s+(\d{4})$"
_Y = r"(?U)^(\d{4})$"


def _month_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])


def _g(s: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(s, pattern, i)


@cached_column
def normalize_date(text) -> Column:
    """Rewrite a date string to ``YYYY-MM-DD``; missing month/day become ``01``;
    anything unrecognised is returned stripped but otherwise unchanged."""
    s = strip(col_(text))
    months = _month_map()
    m_nd = F.try_element_at(months, F.lower(_g(s, _NAME_D_Y, 1)))
    m_dn = F.try_element_at(months, F.lower(_g(s, _D_NAME_Y, 2)))
    m_n = F.try_element_at(months, F.lower(_g(s, _NAME_Y, 1)))
    return (
        F.when(s.rlike(_ISO), s)
        .when(s.rlike(_MDY_SLASH), F.concat_ws("-", _g(s, _MDY_SLASH, 3), F.lpad(_g(s, _MDY_SLASH, 1), 2, "0"),
                                               F.lpad(_g(s, _MDY_SLASH, 2), 2, "0")))
        .when(s.rlike(_MDY_DASH), F.concat_ws("-", _g(s, _MDY_DASH, 3), F.lpad(_g(s, _MDY_DASH, 1), 2, "0"),
                                              F.lpad(_g(s, _MDY_DASH, 2), 2, "0")))
        .when(s.rlike(_NAME_D_Y) & m_nd.isNotNull(),
              F.concat_ws("-", _g(s, _NAME_D_Y, 3), m_nd, F.lpad(_g(s, _NAME_D_Y, 2), 2, "0")))
        .when(s.rlike(_D_NAME_Y) & m_dn.isNotNull(),
              F.concat_ws("-", _g(s, _D_NAME_Y, 3), m_dn, F.lpad(_g(s, _D_NAME_Y, 1), 2, "0")))
        .when(s.rlike(_NAME_Y) & m_n.isNotNull(), F.concat_ws("-", _g(s, _NAME_Y, 2), m_n, F.lit("01")))
        .when(s.rlike(_Y), F.concat(s, F.lit("-01-01")))
        .otherwise(s)
    )


# Every date pattern contains four consecutive digits: text without them cannot match.
DATE_GUARD = r"(?U)\d{4}"


@cached_column
def extract_date_raw(text) -> Column:
    """First date-looking fragment (group 1 of the first matching pattern), or NULL.
    The cascade only runs on text with four consecutive digits (exact pre-test)."""
    t = col_(text)
    cascade = F.coalesce(*[F.nullif(F.regexp_extract(t, DATE_FLAGS + p, 1), F.lit("")) for p in DATE_PATTERNS])
    return F.when(t.rlike(DATE_GUARD), cascade)


@cached_column
def extract_date(text) -> Column:
    """Extracted and normalised publication date, NULL when the text has none."""
    return nonblank(normalize_date(extract_date_raw(text)))
