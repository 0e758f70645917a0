"""RFC 3339 timestamps in UTC with milliseconds, strict both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def format_ms(ts: Column) -> Column:
    return F.date_format(ts, PATTERN)


def parse_ms(text: Column) -> Column:
    """Null for any text that would not be formatted the same again."""
    got = F.try_to_timestamp(text, F.lit(PATTERN))
    return F.when(F.date_format(got, PATTERN) == text, got)
