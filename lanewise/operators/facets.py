"""Facet filters, date ranges and the values a facet offers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.schema import CATEGORIES

Selection = Mapping[str, Sequence[str]]

# The order in which one facet narrows the next.
FACETS = ("branch", "category1", "category2", "cntry_from", "zc_from", "cntry_to", "zc_to", "product", "way")
# Facets whose selection narrows the values offered by the later ones.
NARROWING = ("branch", "category1", "category2", "cntry_from", "cntry_to")
MAP_FACETS = ("product", "branch")


def facets_of(df: DataFrame) -> list[str]:
    """All facets, without the categories unless both of them exist."""
    both = all(c in df.columns for c in CATEGORIES)
    return [f for f in FACETS if both or f not in CATEGORIES]


def _chosen(facet: str, selection: Selection) -> Column:
    """Selected values, or any value but null when nothing is selected."""
    values = selection.get(facet)
    return F.col(facet).isin(*values) if values else F.col(facet).isNotNull()


def _all_of(tests: Sequence[Column]) -> Column:
    combined = F.lit(True)
    for test in tests:
        combined = combined & test
    return combined


def facet_filter(
    df: DataFrame,
    selection: Selection | None = None,
    dates: tuple[date, date] | None = None,
    dates_complete: bool | None = None,
    facets: Sequence[str] | None = None,
) -> DataFrame:
    """Rows that fit every facet and, where it applies, the date range.

    The range is only applied when no row left by the narrowing facets lacks a
    date. That needs a pass of its own over the date column; a caller who knows
    the answer passes ``dates_complete`` and saves it, and the range then
    reaches the scan.
    """
    selection = selection or {}
    facets = list(facets or facets_of(df))
    kept = df.filter(_all_of([_chosen(f, selection) for f in facets]))
    if dates is None:
        return kept
    narrowed = df.filter(_all_of([_chosen(f, selection) for f in facets if f in NARROWING and selection.get(f)]))
    return date_range_filter(kept, dates, dates_complete, checked=narrowed)


def date_range_filter(
    df: DataFrame,
    dates: tuple[date, date],
    dates_complete: bool | None = None,
    checked: DataFrame | None = None,
) -> DataFrame:
    """Inclusive date range, switched off when any date of ``checked`` is missing."""
    if dates_complete is False:
        return df
    in_range = F.col("ship_date").between(F.lit(dates[0]), F.lit(dates[1]))
    if dates_complete:
        return df.filter(in_range)
    source = df if checked is None else checked
    any_missing = source.agg(F.max(F.col("ship_date").isNull())).scalar()
    return df.filter(any_missing | in_range)


def map_filter(
    df: DataFrame,
    selection: Selection | None = None,
    dates: tuple[date, date] | None = None,
    dates_complete: bool | None = None,
) -> DataFrame:
    """The shorter filter of the maps: product, branch and dates."""
    kept = df.filter(_all_of([_chosen(f, selection or {}) for f in MAP_FACETS]))
    return kept if dates is None else date_range_filter(kept, dates, dates_complete, checked=df)


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ship_date").alias("first_date"), F.max("ship_date").alias("last_date"))


def facet_options(df: DataFrame, selection: Selection | None = None) -> DataFrame:
    """Values each facet offers after the selections made in earlier facets.

    One pass: as selections add up from facet to facet, a row offers its values
    up to the first facet whose selection it does not fit. That number is worked
    out once, and duplicates fall away before the shuffle.
    """
    selection = selection or {}
    names = facets_of(df)
    reached = F
    for number, facet in enumerate(names, 1):
        if facet in NARROWING and selection.get(facet):
            reached = reached.when(~F.coalesce(_chosen(facet, selection), F.lit(False)), F.lit(number))
    reached = F.lit(len(names)) if reached is F else reached.otherwise(F.lit(len(names)))
    offered = F.slice(F.array(*names), F.lit(1), reached)
    values = df.select(F.posexplode(offered).alias("facet_no", "value")).distinct()
    return values.select("facet_no", F.get(F.array(*map(F.lit, names)), F.col("facet_no")).alias("facet"), "value")


def zone_list(df: DataFrame, column: str = "zc_from") -> DataFrame:
    """Sorted zones that occur in ``column``."""
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("zone")).distinct().orderBy("zone")
