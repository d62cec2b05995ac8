"""Small column expressions: timestamps, integers from text, bounded messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_CHARS = 300
LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)


def iso_utc(seconds: Column) -> Column:
    """Unix seconds as ``2024-01-31T00:00:00Z`` (the session zone is UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_integer(text: Column) -> Column:
    """Numeric text truncated to an integer, anything else (or null) 0."""
    trimmed = F.trim(text)
    whole = trimmed.rlike(r"^[+-]?[0-9]+$")
    numeric = trimmed.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    clamp = F.when(trimmed.startswith("-"), F.lit(LONG_MIN)).otherwise(F.lit(LONG_MAX))
    wide = trimmed.try_cast("double")
    fits = F.abs(wide) < F.lit(float(2**63))
    return (
        F.when(whole, F.coalesce(trimmed.try_cast("bigint"), clamp))
        .when(numeric & fits, F.when(fits, wide).otherwise(F.lit(0.0)).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
    )


def bounded_message(text: Column, limit: int = MESSAGE_CHARS) -> Column:
    """The head of a message, with an ellipsis where it was cut."""
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)
