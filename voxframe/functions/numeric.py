"""Arithmetic rules that differ from Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column) -> Column:
    """The nearest integer, halves towards plus infinity, as long."""
    return F.floor(value.cast("double") + 0.5)


def rounded(value: Column, places: int) -> Column:
    """``value`` to ``places`` decimals, as double: 10 to the ``places`` times it to the nearest integer, halves away from zero, and divided again. A zero keeps its sign.

    Spark's own ``round`` goes by the decimal digits of the value, so it differs where the multiplication rounds.
    """
    value = value.cast("double")
    scaled = F.abs(value) * 10.0**places
    whole = F.rint(scaled)
    # Of two integers as near, rint takes the even one.
    whole = F.when(scaled - whole == 0.5, whole + 1.0).otherwise(whole)
    return F.when(scaled == math.inf, value).otherwise(F.signum(value) * (whole / 10.0**places))


def or_default(value: Column, default: float) -> Column:
    """``value``, or ``default`` where it is null, zero or not a number."""
    return F.when(value.isNull() | (value == 0) | F.isnan(value.cast("double")), F.lit(default)).otherwise(value)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high) if not isinstance(high, Column) else high, value))


def fixed(value: Column, places: int) -> Column:
    """Decimal text with ``places`` digits after the point."""
    return F.format_string(f"%.{places}f", value.cast("double"))
