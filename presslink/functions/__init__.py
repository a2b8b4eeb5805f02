"""Pure ``Column -> Column`` rules. Everything here compiles to Catalyst expressions."""

from presslink.functions.dates import extract_date, extract_date_raw, normalize_date
from presslink.functions.headings import is_heading
from presslink.functions.names import normalize_name
from presslink.functions.sources import extract_source
from presslink.functions.text import WS, is_boundary, strip

__all__ = [
    "WS", "extract_date", "extract_date_raw", "extract_source",
    "is_boundary", "is_heading", "normalize_date", "normalize_name", "strip",
]
