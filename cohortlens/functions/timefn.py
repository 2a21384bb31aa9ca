"""Date/time arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_US_PER_HOUR = 3_600_000_000.0
_US_PER_DAY = 86_400_000_000.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _name(c: str) -> str:
    if not isinstance(c, str):
        raise TypeError("pass column names; materialise expressions with withColumn first")
    return "`" + c.replace("`", "``") + "`"


def micros_between(start: str, end: str) -> Column:
    """end - start in microseconds (null if either side is null).

    ``timestampdiff`` is exact on TIMESTAMP_NTZ and independent of the
    session time zone; it has no Column function, hence the SQL expression.
    """
    return F.expr(f"timestampdiff(MICROSECOND, {_name(start)}, {_name(end)})")


def hours_between(start, end) -> Column:
    return micros_between(start, end) / F.lit(_US_PER_HOUR)


def days_between(start, end) -> Column:
    return micros_between(start, end) / F.lit(_US_PER_DAY)


def add_hours(c, hours: int) -> Column:
    return _c(c) + F.expr(f"INTERVAL {int(hours)} HOURS")


def to_timestamp_lenient(c, fmt: str | None = None) -> Column:
    """Parse text to TIMESTAMP_NTZ; unparsable values become null (errors='coerce')."""
    col = _c(c)
    parsed = F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)
    return parsed.cast("timestamp_ntz")
