"""Collection rhythm: totals per day, weekday and month, and daily loading metres."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.dates import day_name, day_number, month_of
from lanewise.functions.numbers import total, total_double
from lanewise.schema import WEEKDAYS

SUMS = ("kg", "ldm", "pay_weight")


def _days(df: DataFrame) -> DataFrame:
    """One row per day, sums in the exact type of the measures."""
    return (
        df.filter(F.col("ship_date").isNotNull())
        .groupBy("ship_date")
        .agg(F.count("ship_date").alias("shipments"), *[total(s).alias(s) for s in SUMS])
    )


def daily_totals(df: DataFrame) -> DataFrame:
    return _days(df).select("ship_date", "shipments", *[F.col(s).cast("double").alias(s) for s in SUMS])


def weekday_totals(df: DataFrame) -> DataFrame:
    """Collection days and totals of all seven weekdays, Monday first.

    Seven empty rows are added to the days, so weekdays without a shipment
    appear with zeros and no join is needed.
    """
    days = _days(df)
    dated = days.select(day_number("ship_date").alias("day_no"), F.lit(1).alias("collections"), "shipments", *SUMS)
    empty = df.sparkSession.range(len(WEEKDAYS)).select(
        F.col("id").cast("int").alias("day_no"),
        F.lit(0).alias("collections"),
        F.lit(0).cast("bigint").alias("shipments"),
        *[F.lit(0).cast(days.schema[s].dataType).alias(s) for s in SUMS],
    )
    return (
        dated.unionByName(empty)
        .groupBy("day_no")
        .agg(
            F.sum("collections").alias("collections"),
            F.sum("shipments").alias("shipments"),
            *[total_double(s).alias(s) for s in SUMS],
        )
        .withColumn("day", day_name(F.col("day_no")))
        .orderBy("day_no")
    )


def collection_totals(df: DataFrame) -> DataFrame:
    """Grand totals over all dated shipments."""
    return df.filter(F.col("ship_date").isNotNull()).agg(
        F.count("ship_date").alias("shipments"), *[total_double(s).alias(s) for s in SUMS]
    )


def daily_describe(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the daily totals."""
    names = ("shipments", *SUMS)
    doubles = _days(df).select(*[F.col(n).cast("double").alias(n) for n in names])
    long = doubles.unpivot([], list(names), "measure", "value")
    quartile = {q: F.percentile("value", F.lit(q)) for q in (0.25, 0.5, 0.75)}
    return long.groupBy("measure").agg(
        F.count("value").alias("days"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        quartile[0.25].alias("p25"),
        quartile[0.5].alias("p50"),
        quartile[0.75].alias("p75"),
        F.max("value").alias("max"),
    )


def working_days(df: DataFrame) -> DataFrame:
    """Days with a collection, those of them on a working day, and collections per week."""
    days = df.filter(F.col("ship_date").isNotNull()).select("ship_date").distinct()
    counted = days.agg(
        F.count("ship_date").alias("total_days"), F.count_if(day_number("ship_date") < 5).alias("working_days")
    )
    per_week = F.try_divide(F.col("working_days").cast("double"), F.col("total_days").cast("double")) * 5.0
    return counted.withColumn("per_week", per_week)


def ldm_bucket(metres: Column) -> Column:
    """Position of a day's loading metres: 0.5, 1 to 10, a full truck, more than one."""
    chain = F.when(metres <= F.lit(Decimal("0.5")), 0)
    for bound in range(1, 11):
        chain = chain.when(metres <= bound, bound)
    return chain.when(metres <= F.lit(Decimal("13.6")), 11).otherwise(12)


def ldm_buckets(df: DataFrame) -> DataFrame:
    """Number of days per bucket of daily loading metres."""
    days = (
        df.filter(F.col("ldm").isNotNull() & F.col("ship_date").isNotNull())
        .groupBy("ship_date")
        .agg(F.sum("ldm").alias("ldm"))
    )
    counted = days.groupBy(ldm_bucket(F.col("ldm")).alias("ord")).agg(F.count("ldm").alias("collections"))
    label = (
        F.when(F.col("ord") == 0, "0.5")
        .when(F.col("ord") == 11, "FTL")
        .when(F.col("ord") == 12, "sup.FTL")
        .otherwise(F.col("ord").cast("string"))
    )
    return counted.select("ord", label.alias("bucket"), "collections")


def collection_seasonality(df: DataFrame) -> DataFrame:
    """Collections with loading metres per month."""
    dated = df.filter(F.col("ldm").isNotNull() & F.col("ship_date").isNotNull())
    return dated.groupBy(month_of("ship_date").alias("month")).agg(F.count("kg").alias("collections"))
