"""Cleaning of a shipment table: types, gaps, unusable rows, zone spelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.schema import COLLAPSED_COUNTRIES, MEASURES

# A cast alone would also take suffixes like 12d and words like Infinity.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

#: Tried after ISO dates and the caller's own formats; with points and hyphens the day comes first.
DAY_FIRST_FORMATS = ("d.M.yyyy", "d-M-yyyy")
#: With slashes either comes first.
SLASH_FORMATS = ("M/d/yyyy", "d/M/yyyy")


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _number(df: DataFrame, name: str) -> Column:
    """The measure as a number; text that is no number and values that are not finite become null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return _finite(F.when(F.rlike(F.col(name), F.lit(NUMBER)), F.trim(F.col(name)).try_cast("double")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _finite(F.col(name))
    return F.col(name)


def day_comes_first(df: DataFrame, name: str) -> DataFrame:
    """One row: whether a column's dates with slashes are to be read day first.

    A vote of the whole column in one pass: texts that are a date only if the day
    comes first against those that are one only if the month does. With equal
    votes, or none, the month comes first.
    """
    text = F.trim(F.col(name))
    month, day = (F.try_to_timestamp(text, F.lit(f)).isNotNull() for f in SLASH_FORMATS)
    return df.agg((F.count_if(day & ~month) > F.count_if(month & ~day)).alias("day_first"))


def _date(df: DataFrame, name: str, formats: Sequence[str], by_column: bool) -> Column:
    kind = df.schema[name].dataType
    if not isinstance(kind, T.StringType):
        return F.col(name).cast("date")
    text = F.trim(F.col(name))
    month, day = (F.try_to_timestamp(text, F.lit(f)) for f in SLASH_FORMATS)
    slashes = F.coalesce(month, day)
    if by_column:
        slashes = F.when(day_comes_first(df, name).scalar(), F.coalesce(day, month)).otherwise(slashes)
    own, pointed = ([F.try_to_timestamp(text, F.lit(f)) for f in given] for given in (formats, DAY_FIRST_FORMATS))
    return F.to_date(F.coalesce(F.try_to_timestamp(text), *own, slashes, *pointed))


def coerce_types(df: DataFrame, date_formats: Sequence[str] = (), by_column: bool = True) -> DataFrame:
    """Measures to numbers and ``ship_date`` to a date; bad values become null.

    Dates are ISO, in one of ``date_formats``, with slashes, or in one of
    ``DAY_FIRST_FORMATS``. With slashes the whole column is read in the order that
    its unambiguous texts have (:func:`day_comes_first`, a pass of its own); a text
    that is no date in that order is read in the other. ``by_column=False`` asks
    each text alone, month first if both are dates, as streams have to.
    """
    typed = {name: _number(df, name) for name in MEASURES}
    typed["ship_date"] = _date(df, "ship_date", date_formats, by_column)
    return df.withColumns(typed)


def _usable(df: DataFrame) -> Column:
    """True for usable rows, false or null for the others."""
    kg, ldm, m3 = (_number(df, name) != 0 for name in MEASURES)
    return F.col("zc_from").isNotNull() & F.col("zc_to").isNotNull() & (kg | ldm | m3)


def normalise_zone(zone: str | Column) -> Column:
    """Reduce the collapsed countries to their code and write GB as UK."""
    zone = F.col(zone) if isinstance(zone, str) else zone
    code = F.substring(zone, 1, 2)
    return (
        F.when(code.isin(*COLLAPSED_COUNTRIES), code)
        .when(code == "GB", F.concat(F.lit("UK"), zone.substr(F.lit(3), F.length(zone))))
        .otherwise(zone)
    )


def clean_shipments(raw: DataFrame, date_formats: Sequence[str] = (), by_column: bool = True) -> DataFrame:
    """Keep usable rows, fill gaps and normalise zones and types; dates as in :func:`coerce_types`.

    A missing measure (null or NaN) counts as 0, while text that is no number
    and infinite values become null: such a row keeps its place as long as
    another measure is there.
    """
    filled = {name: F.when(F.col(name).isNull(), F.lit(0)).otherwise(_number(raw, name)) for name in MEASURES}
    for name in MEASURES:
        if isinstance(raw.schema[name].dataType, (T.DoubleType, T.FloatType)):
            filled[name] = _finite(F.nanvl(F.coalesce(F.col(name), F.lit(0.0)), F.lit(0.0)))
        elif isinstance(raw.schema[name].dataType, T.DecimalType):
            filled[name] = F.coalesce(F.col(name), F.lit(0)).cast(raw.schema[name].dataType)
    return raw.filter(_usable(raw)).withColumns(
        {
            **filled,
            "ship_date": _date(raw, "ship_date", date_formats, by_column),
            "branch": F.coalesce("branch", F.lit("undefined")),
            "zc_from": normalise_zone("zc_from"),
            "zc_to": normalise_zone("zc_to"),
        }
    )


def rejected_rows(raw: DataFrame) -> DataFrame:
    """The raw rows that :func:`clean_shipments` leaves out, unchanged."""
    return raw.filter(~F.coalesce(_usable(raw), F.lit(False)))


def rejected_count(raw: DataFrame) -> DataFrame:
    return rejected_rows(raw).agg(F.count(F.lit(1)).alias("rejected"))
