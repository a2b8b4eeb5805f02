"""Run options with the reference defaults (validated on the driver, not data)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


def valid_date_option(value: str) -> bool:
    """``YYYY-MM-DD`` as ``strptime`` reads it (``2020-1-1`` is accepted)."""
    try:
        datetime.strptime(value, "%Y-%m-%d")
        return True
    except (TypeError, ValueError):
        return False


@dataclass(frozen=True)
class Options:
    max_description_length: int = 300
    default_date: str = "1900-01-01"
    default_source: str = "Unknown Source"
    top_k: int = 5
    low_threshold: int = 62
    high_threshold: int = 93

    def __post_init__(self):
        if self.max_description_length <= 0:
            raise ValueError("max_description_length must be positive")
        if not self.default_date or not valid_date_option(self.default_date):
            raise ValueError("default_date must be in YYYY-MM-DD format")
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")
