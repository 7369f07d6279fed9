"""Weekday regularity of each lane, branch, product and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.dates import day_number
from lanewise.functions.shapes import counts_by_value
from lanewise.operators.enrich import lane_key
from lanewise.schema import DAY_COLUMNS

KEYS = ("lane", "branch", "product", "way")

# A day's share of the week, in percent, from which each colour step starts.
SHARE_STEPS = (92, 83, 75, 67, 58, 50, 42, 33, 25, 17, 8)


def regularity(df: DataFrame) -> DataFrame:
    """Shipments per weekday with their total and the mean loading metres."""
    dated = df.filter(F.col("ship_date").isNotNull() & F.col("branch").isNotNull())
    with_keys = dated.withColumns({"lane": lane_key(), "day_no": day_number("ship_date")})
    metres = F.try_divide(F.sum("ldm").cast("double"), F.count("ldm").cast("double"))
    return (
        with_keys.groupBy(*KEYS)
        .agg(
            metres.alias("average_ldm"),
            *counts_by_value("day_no", dict(enumerate(DAY_COLUMNS)), "pay_weight"),
            F.count("pay_weight").alias("total"),
        )
        .filter("total > 0")
    )


def weekly_trend(df: DataFrame) -> DataFrame:
    """The seven counts as an array, Monday first."""
    return regularity(df).select(*KEYS, F.array(*DAY_COLUMNS).alias("trend"))


def share_band(count: Column, whole: Column) -> Column:
    """Step of a day's share: all of it, above one of the steps, or below the lowest.

    A share of exactly the lowest step belongs to no band.
    """
    chain = F.when(count == whole, "=100")
    for step in SHARE_STEPS:
        chain = chain.when(count * 100 > whole * step, f">{step}")
    return chain.when(count * 100 < whole * SHARE_STEPS[-1], f"<{SHARE_STEPS[-1]}")


def regularity_band(df: DataFrame) -> DataFrame:
    return regularity(df).select(*KEYS, *[share_band(F.col(d), F.col("total")).alias(d) for d in DAY_COLUMNS])
