"""Times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_text(ts: Column) -> Column:
    """ISO 8601 text in UTC with milliseconds, ``2024-01-31T12:00:00.000Z``, whatever the session's time zone is; a time without a zone is taken for UTC.

    Milliseconds are cut off, not rounded. Null gives null.
    """
    # Of a time without a zone the text is its own; of one with a zone that of its instant.
    plain = F.when(F.typeof(ts) == "timestamp_ntz", ts.cast("timestamp_ntz")).otherwise(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")))
    text = plain.cast("string")
    fraction = F.regexp_extract(text, r"\.(\d+)$", 1)
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), F.rpad(F.substring(fraction, 1, 3), 3, "0"), F.lit("Z"))


def from_iso(text: Column) -> Column:
    """The instant of such a text; null for any other."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z$"), F.try_to_timestamp(text))
