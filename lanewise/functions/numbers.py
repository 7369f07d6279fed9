"""Sums, rounding and display formats used by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(col: str | Column) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(col), F.lit(0))


def total_double(col: str | Column) -> Column:
    """Sum in the column's own (exact) type, returned as a double."""
    return total(col).cast("double")


def half_up_ratio(part: Column, whole: Column, decimals: int, scale: int = 1) -> Column:
    """``scale * part / whole`` rounded half up to ``decimals`` places.

    Works on integers throughout, so the result does not depend on how a
    double happens to represent a tie. Null when ``whole`` is 0.
    """
    unit = 10**decimals
    whole = F.nullif(whole.cast("bigint"), F.lit(0).cast("bigint"))
    doubled = F.lit(2 * scale * unit).cast("bigint") * part.cast("bigint") + whole
    steps = F.call_function("div", doubled, F.lit(2).cast("bigint") * whole)
    return steps.cast("double") / F.lit(float(unit))


def percent(part: Column, whole: Column, decimals: int = 2) -> Column:
    return half_up_ratio(part, whole, decimals, scale=100)


def thousands(col: str | Column) -> Column:
    """No decimals, blanks between groups of three digits."""
    value = F.col(col) if isinstance(col, str) else col
    return F.translate(F.format_number(value, 0), ",", " ")
