"""Small reshaping helpers: conditional pivots and one-row-to-many-rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by_value(column: str | Column, names: Mapping, counted: str) -> list[Column]:
    """One conditional count per known value of ``column``.

    A pivot over a known list of values needs one shuffle on the group keys
    this way; ``groupBy().pivot()`` would first shuffle on keys plus value.
    """
    key = F.col(column) if isinstance(column, str) else column
    present = F.col(counted).isNotNull()
    return [F.count_if((key == F.lit(value)) & present).alias(name) for value, name in names.items()]


def rows_from(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Turn each row of ``df`` (normally a single one) into ``len(rows)`` rows."""
    return df.select(F.inline(F.array(*rows)))
