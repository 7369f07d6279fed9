"""Lane profile: shipments per lane and weight bracket, totals, shares and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.numbers import percent
from lanewise.functions.shapes import counts_by_value, rows_from
from lanewise.operators.enrich import country_of
from lanewise.schema import BRACKET_COLUMNS

LANE = ("cntry_from", "zc_from", "cntry_to", "zc_to")
COLUMNS = tuple(BRACKET_COLUMNS.values())


def _lanes(df: DataFrame) -> DataFrame:
    """Bracket counts per lane; a single shuffle on the two zones.

    The countries are the beginnings of the zones, so they need no place among
    the group keys.
    """
    keyed = df.filter(F.col("zc_from").isNotNull() & F.col("zc_to").isNotNull())
    counted = keyed.groupBy("zc_from", "zc_to").agg(
        *counts_by_value("bracket", BRACKET_COLUMNS, "pay_weight"), F.count("pay_weight").alias("total")
    )
    named = counted.withColumns({"cntry_from": country_of("zc_from"), "cntry_to": country_of("zc_to")})
    return named.filter("total > 0").select(*LANE, *COLUMNS, "total")


def _counted(df: DataFrame) -> DataFrame:
    """Bracket counts over everything, straight from the shipments."""
    keyed = df.filter(F.col("zc_from").isNotNull() & F.col("zc_to").isNotNull())
    return keyed.agg(*counts_by_value("bracket", BRACKET_COLUMNS, "pay_weight"), F.count("pay_weight").alias("total"))


def lane_profile(df: DataFrame) -> DataFrame:
    """Lane x bracket counts with each lane's share of all shipments.

    The grand total is asked for together with all bracket totals: both then
    need the very same lane counts, and Spark shuffles the shipments only once.
    """
    lanes = _lanes(df)
    sums = lanes.agg(F.struct(*[F.sum(c).alias(c) for c in (*COLUMNS, "total")])).scalar()
    shared = lanes.withColumn("sums", sums)
    return shared.withColumn("share", percent(F.col("total"), F.col("sums.total"))).drop("sums")


def profile_totals(df: DataFrame) -> DataFrame:
    """Two rows: the percentage of each bracket, then its count."""
    total_row = [F.col(c).cast("double").alias(c) for c in (*COLUMNS, "total")]
    percent_row = [percent(F.col(c), F.col("total"), 1).alias(c) for c in (*COLUMNS, "total")]
    return rows_from(
        _counted(df),
        [
            F.struct(F.lit(0).alias("ord"), F.lit("%").alias("label"), *percent_row),
            F.struct(F.lit(1).alias("ord"), F.lit("Total").alias("label"), *total_row),
        ],
    )


def _bracket_extents() -> tuple[Column, Column]:
    """Lowest and highest percentage over the brackets that occur."""
    seen = [F.when(F.col(c) > 0, percent(F.col(c), F.col("total"), 1)) for c in COLUMNS]
    return F.least(*seen), F.greatest(*seen)


def profile_extents(df: DataFrame) -> DataFrame:
    """Ends of the colour scales: lane share, lane total and bracket percentage."""
    over_lanes = _lanes(df).agg(
        F.min("total").alias("min_total"),
        F.max("total").alias("max_total"),
        F.sum("total").alias("total"),
        *[F.sum(c).alias(c) for c in COLUMNS],
    )
    lowest, highest = _bracket_extents()
    return over_lanes.select(
        percent(F.col("min_total"), F.col("total")).alias("min_share"),
        percent(F.col("max_total"), F.col("total")).alias("max_share"),
        "min_total",
        "max_total",
        lowest.alias("min_bracket_pct"),
        highest.alias("max_bracket_pct"),
    )


def _scaled(value: Column, low: Column, high: Column) -> Column:
    """Position between ``low`` and ``high`` from 0 to 100; null when they are equal."""
    return F.when(high != low, (value - low) / (high - low) * 100.0)


def _band(position: Column, green: int, orange: int) -> Column:
    return F.when(position >= green, "high").when(position >= orange, "middle").otherwise("low")


def profile_bands(df: DataFrame) -> DataFrame:
    """Colour bands of the lane share (relative) and of the lane total (absolute)."""
    lanes = _lanes(df)
    ends = lanes.agg(F.struct(F.min("total").alias("low"), F.max("total").alias("high"), F.sum("total").alias("all")))
    with_ends = lanes.withColumn("ends", ends.scalar())
    everything = F.col("ends.all")
    share = percent(F.col("total"), everything)
    position = _scaled(share, percent(F.col("ends.low"), everything), percent(F.col("ends.high"), everything))
    return with_ends.select(
        *LANE,
        "total",
        share.alias("share"),
        position.alias("share_position"),
        _band(position, 75, 50).alias("share_band"),
        F.when(F.col("total") >= 80, ">=80")
        .when(F.col("total") >= 60, ">=60")
        .when(F.col("total") >= 30, ">=30")
        .otherwise("<30")
        .alias("total_band"),
    )


def profile_bracket_bands(df: DataFrame) -> DataFrame:
    """Colour band of each bracket that occurs, by its percentage."""
    lowest, highest = _bracket_extents()
    spread = _counted(df).withColumns({"lowest": lowest, "highest": highest})
    rows = rows_from(
        spread,
        [
            F.struct(
                F.lit(bound).alias("bracket"),
                F.col(name).alias("shipments"),
                percent(F.col(name), F.col("total"), 1).alias("pct"),
                F.col("lowest"),
                F.col("highest"),
            )
            for bound, name in BRACKET_COLUMNS.items()
        ],
    )
    position = _scaled(F.col("pct"), F.col("lowest"), F.col("highest"))
    return rows.filter("shipments > 0").select(
        "bracket", "pct", position.alias("pct_position"), _band(position, 80, 30).alias("pct_band")
    )
