"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.schema import WEEKDAYS


def month_of(col: str) -> Column:
    return F.date_format(F.col(col), "yyyy-MM")


def day_number(col: str) -> Column:
    """Monday is 0."""
    return F.weekday(F.col(col))


def day_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), number + 1)
