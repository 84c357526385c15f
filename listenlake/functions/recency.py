"""Elapsed days and exponential decay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bound of the half-life and the share of the listening span it is made of.
MIN_HALF_LIFE_DAYS = 30.0
SPAN_SHARE = 3.0


def instant(value: datetime | str | Column) -> Column:
    """A point in time given as Python datetime, text or column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole 24-hour units, toward zero; calendar borders do not count."""
    return F.timestamp_diff("DAY", start, end)


def decay_e(days: Column, scale: Column) -> Column:
    """``e^(-days/scale)``, used for play statistics."""
    return F.exp(-(days / scale))


def decay_2(days: Column, half_life: Column) -> Column:
    """``2^(-days/half_life)``, used for forgotten favourites."""
    return F.pow(F.lit(2.0), -(days / half_life))


def half_life_days(span_days: Column) -> Column:
    return F.greatest(span_days / F.lit(SPAN_SHARE), F.lit(MIN_HALF_LIFE_DAYS))
