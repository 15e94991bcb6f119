"""Durations such as ``20m`` or ``120s``, and time cells on the epoch."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit -> microseconds.
UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
_DURATION = re.compile(r"\s*(\d+)\s*(ms|s|m|h|d)\s*", re.IGNORECASE)


def micros(text: str | int) -> int:
    """Length of a duration in microseconds; integers pass through."""
    if isinstance(text, int):
        return text
    match = _DURATION.fullmatch(str(text))
    if not match or int(match.group(1)) == 0:
        raise ValueError(f"not a duration: {text!r}")
    return int(match.group(1)) * UNITS[match.group(2).lower()]


def cell(us: Column, width: int) -> Column:
    """Number of the epoch-aligned cell of `width` microseconds holding `us` (floor, also before 1970)."""
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def event_us(column: str | Column = "event_time") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column)
