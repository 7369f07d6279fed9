"""Regional totals: zone values split evenly over the regions of a zone.

The zone-to-region bridge has the columns ``zone``, ``nuts0`` to ``nuts3`` and
``seq``, and several rows per zone. Region attributes have ``lvl``,
``region_id``, ``name``, ``lat`` and ``lon``; polygons come as vertices with
``region_id``, ``part``, ``ring``, ``seq``, ``lon`` and ``lat``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.numbers import total, total_double

LEVELS = ("nuts0", "nuts1", "nuts2", "nuts3")
VARIABLES = ("shipments", "pay_weight", "kg", "ldm", "m3")


def _measure(variable: str) -> Column:
    if variable not in VARIABLES:
        raise ValueError(f"unknown variable {variable!r}, expected one of {VARIABLES}")
    return F.count("pay_weight") if variable == "shipments" else total(variable)


def zone_values(df: DataFrame, zone: str, variable: str = "shipments") -> DataFrame:
    """Number of shipments or sum of a measure per zone."""
    return (
        df.filter(F.col(zone).isNotNull())
        .groupBy(F.col(zone).alias("zone"))
        .agg(_measure(variable).cast("double").alias("value"))
    )


def region_weights(bridge: DataFrame, level: int) -> DataFrame:
    """Share of a zone that belongs to each of its regions.

    Worked out on the bridge alone, before any shipment is read, and reduced
    to one row per zone and region.
    """
    fan_out = F.sum("entries").over(Window.partitionBy("zone"))
    return (
        bridge.groupBy("zone", F.col(LEVELS[level]).alias("region_id"))
        .agg(F.count(F.lit(1)).alias("entries"))
        .withColumn("fan_out", fan_out)
        .filter(F.col("region_id").isNotNull())
    )


def split_over_regions(values: DataFrame, bridge: DataFrame, level: int = 0) -> DataFrame:
    """Regional sums of zone values; zones that the bridge lacks drop out.

    Shipments are already one row per zone here, so the join moves no raw rows
    and each zone meets at most a handful of regions.
    """
    share = F.col("value") * F.col("entries") / F.col("fan_out")
    return (
        values.join(region_weights(bridge, level), "zone").groupBy("region_id").agg(F.sum(share).alias("value"))
    )


def attach_regions(totals: DataFrame, attributes: DataFrame, level: int = 0) -> DataFrame:
    """Name and position of each region; regions without attributes stay."""
    named = attributes.filter(F.col("lvl") == level).select("region_id", "name", "lat", "lon")
    return named.join(totals, "region_id", "right").select("region_id", "name", "lat", "lon", "value")


def region_delivery(df: DataFrame, bridge: DataFrame, level: int = 0) -> DataFrame:
    return split_over_regions(zone_values(df, "zc_to"), bridge, level)


def region_collection(df: DataFrame, bridge: DataFrame, level: int = 0) -> DataFrame:
    return split_over_regions(zone_values(df, "zc_from"), bridge, level)


def outbound_map(
    df: DataFrame,
    bridge: DataFrame,
    attributes: DataFrame,
    origin: str,
    level: int = 0,
    variable: str = "shipments",
) -> DataFrame:
    """Regions reached from one zone."""
    values = zone_values(df.filter(F.col("zc_from") == origin), "zc_to", variable)
    return attach_regions(split_over_regions(values, bridge, level), attributes, level)


def inbound_map(
    df: DataFrame,
    bridge: DataFrame,
    attributes: DataFrame,
    destination: str,
    level: int = 0,
    variable: str = "shipments",
) -> DataFrame:
    """Regions that supply one zone."""
    values = zone_values(df.filter(F.col("zc_to") == destination), "zc_from", variable)
    return attach_regions(split_over_regions(values, bridge, level), attributes, level)


def top_zones_by_variable(df: DataFrame, zone: str = "zc_from", variable: str = "shipments", top: int = 10) -> DataFrame:
    """Largest zones by shipments or by a measure, smallest first."""
    rows = df if variable == "shipments" else df.filter(F.col(variable).isNotNull())
    lead = F.count("pay_weight").alias("shipments") if variable == "shipments" else None
    sums = ("kg", "ldm", "m3") if lead is not None else ("pay_weight", "kg", "ldm", "m3")
    aggregates = ([lead] if lead is not None else []) + [total_double(s).alias(s) for s in sums]
    grouped = rows.filter(F.col(zone).isNotNull()).groupBy(F.col(zone).alias("zone")).agg(*aggregates)
    largest = grouped.orderBy(F.desc(variable), "zone").limit(top)
    return largest.orderBy(variable, F.desc("zone"))


def marker_radius(totals: DataFrame) -> DataFrame:
    """Circle size from 5 to 20 by value; 10 when all values are equal or missing."""
    ends = totals.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"))).scalar()
    scaled = totals.withColumn("ends", ends)
    low, high = F.col("ends.low"), F.col("ends.high")
    radius = F.when(high != low, (F.col("value") - low) / (high - low) * 15.0 + 5.0)
    return scaled.withColumn("radius", F.coalesce(radius, F.lit(10.0))).drop("ends")


def region_centroid(vertices: DataFrame) -> DataFrame:
    """Planar centroid of each region.

    The first ring of a part adds to the area and the others are holes, whatever
    way round they were drawn. Regions without an area get the mean vertex.
    """
    ring = Window.partitionBy("region_id", "part", "ring").orderBy("seq")
    whole_ring = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = vertices.select(
        "region_id",
        "part",
        "ring",
        "lon",
        "lat",
        F.coalesce(F.lead("lon").over(ring), F.first("lon").over(whole_ring)).alias("next_lon"),
        F.coalesce(F.lead("lat").over(ring), F.first("lat").over(whole_ring)).alias("next_lat"),
    )
    cross = F.col("lon") * F.col("next_lat") - F.col("next_lon") * F.col("lat")
    rings = edges.groupBy("region_id", "part", "ring").agg(
        F.sum(cross).alias("area2"),
        F.sum((F.col("lon") + F.col("next_lon")) * cross).alias("mx"),
        F.sum((F.col("lat") + F.col("next_lat")) * cross).alias("my"),
        F.sum("lon").alias("sum_lon"),
        F.sum("lat").alias("sum_lat"),
        F.count(F.lit(1)).alias("points"),
    )
    sign = F.signum("area2") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    regions = rings.groupBy("region_id").agg(
        F.sum(sign * F.col("area2")).alias("area2"),
        F.sum(sign * F.col("mx")).alias("mx"),
        F.sum(sign * F.col("my")).alias("my"),
        F.sum("sum_lon").alias("sum_lon"),
        F.sum("sum_lat").alias("sum_lat"),
        F.sum("points").alias("points"),
    )
    flat = F.col("area2") == 0

    def centre(moment: str, plain_sum: str) -> Column:
        weighted = F.try_divide(F.col(moment), F.col("area2") * 3.0)
        return F.when(flat, F.col(plain_sum) / F.col("points")).otherwise(weighted)

    return regions.select("region_id", centre("mx", "sum_lon").alias("lon"), centre("my", "sum_lat").alias("lat"))


def zone_anchor(bridge: DataFrame) -> DataFrame:
    """The first level-3 region of each zone."""
    return bridge.groupBy("zone").agg(F.min_by("nuts3", "seq").alias("region_id"))


def zone_centroid(bridge: DataFrame, vertices: DataFrame) -> DataFrame:
    """Position of a zone on the map: the centroid of its first level-3 region."""
    return zone_anchor(bridge).join(region_centroid(vertices), "region_id")
