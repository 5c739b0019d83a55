"""Event-time helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNIT_MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "sec": 1_000_000,
    "second": 1_000_000,
    "min": 60_000_000,
    "minute": 60_000_000,
    "h": 3_600_000_000,
    "hour": 3_600_000_000,
    "d": 86_400_000_000,
    "day": 86_400_000_000,
}


def window_micros(window: str | int) -> int:
    """``"1s"``, ``"5min"``, ``"6 hours"`` or a plain number of microseconds."""
    if isinstance(window, int):
        size = window
    else:
        found = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+?)s?\s*|\s*(\d+)\s*(s)\s*", window)
        if not found:
            raise ValueError(f"cannot read window {window!r}")
        amount, unit = (found[1] or found[3]), (found[2] or found[4]).lower()
        if unit not in _UNIT_MICROS and unit + "s" in _UNIT_MICROS:
            unit += "s"
        if unit not in _UNIT_MICROS:
            raise ValueError(f"unknown unit in window {window!r}")
        size = int(amount) * _UNIT_MICROS[unit]
    if size <= 0:
        raise ValueError("window must be positive")
    return size


def event_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch for either timestamp type, whatever the session zone."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampNTZType):
        # From the fields, because a cast would go through the session zone.
        return F.expr(
            f"unix_date(CAST(`{ts}` AS DATE)) * 86400000000L + hour(`{ts}`) * 3600000000L"
            f" + minute(`{ts}`) * 60000000L + CAST(extract(SECOND FROM `{ts}`) * 1000000 AS BIGINT)"
        )
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(ts))
    if isinstance(kind, T.LongType):
        return F.col(ts)
    raise TypeError(f"{ts} is {kind.simpleString()}, not an event time")


# Accepted timestamp layouts. ISO first (never day-swapped), then day first,
# then month first for strings that have no day-first reading.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "d/M/yyyy h:mm:ss a",
    "d/M/yyyy HH:mm:ss.SSSSSS",
    "d/M/yyyy HH:mm:ss",
    "d/M/yyyy HH:mm",
    "d/M/yyyy",
    "d-M-yyyy HH:mm:ss",
    "d-M-yyyy",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy HH:mm",
    "M/d/yyyy",
]


def parse_timestamp(text: Column, formats: list[str] = TIMESTAMP_FORMATS) -> Column:
    """Mixed-layout, day-first timestamp parsing; unreadable or empty text becomes null."""
    tidy = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(tidy, F.lit(layout)) for layout in formats])
