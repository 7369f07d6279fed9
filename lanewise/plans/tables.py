"""Shipments, regions, branches, tender rows and answers derived from the test tables.

``FIXTURES.md`` describes each of them; ``plans/oracle.py`` holds the same
definitions as SQL for the check in another engine.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators.clean import clean_shipments
from lanewise.operators.enrich import enrich_shipments
from lanewise.operators.summary import summary_rows
from lanewise.schema import COLLAPSED_COUNTRIES, Params

# Two-letter code of nation key n at position 2 * n.
CODES = "FRDEESITPLGBBENLSENODKFIATCZPTIEHUROUARUBAMEBYADXK"

# Country names by nation key.
COUNTRIES = (
    "france", "germany", "spain", "italy", "poland", "united kingdom", "belgium", "netherlands", "sweden",
    "norway", "denmark", "finland", "austria", "czech republic", "portugal", "ireland", "hungary", "romania",
    "ukraine", "russia", "bosnia", "montenegro", "belarus", "andorra", "kosovo",
)


# Part, ring, position and offset of the corners of an outline.
CORNERS = (
    (0, 0, 0, 0.0, 0.0), (0, 0, 1, 2.0, 0.0), (0, 0, 2, 2.0, 2.0), (0, 0, 3, 0.0, 2.0), (0, 0, 4, 0.0, 0.0),
    (0, 1, 0, 0.5, 0.5), (0, 1, 1, 1.0, 0.5), (0, 1, 2, 1.0, 1.0), (0, 1, 3, 0.5, 1.0), (0, 1, 4, 0.5, 0.5),
    (1, 0, 0, 5.0, 5.0), (1, 0, 1, 6.0, 5.0), (1, 0, 2, 6.0, 6.0), (1, 0, 3, 5.0, 6.0), (1, 0, 4, 5.0, 5.0),
)


def _code(nation: str) -> Column:
    return F.substring(F.lit(CODES), F.col(nation) * 2 + 1, F.lit(2))


def _two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _zone(nation: str, number: str) -> Column:
    return F.concat_ws(" ", _code(nation), _two_digits(F.col(number) % 100))


def _nine_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 9, "0")


def _region(number: Column) -> Column:
    return F.concat(F.lit("R"), _nine_digits(number))


def _in_order(entry: Column, field: str) -> Column:
    """The field of all entries, sorted by the entries' first field."""
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e[field])


def _decimal(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("decimal(18,3)")


class Tables:
    """Lazy tables over one folder of test data."""

    def __init__(self, spark: SparkSession, folder: str, params: Params = Params()):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.params = params

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        """Raw shipments: one per line item."""
        key = F.col("l_orderkey") + F.col("l_partkey")
        part, line = F.col("l_partkey"), F.col("l_linenumber")
        empty = part % 13 == 0
        quantity = F.col("l_quantity").cast("int") * line * line * line
        metres = F.when(line >= 5, part % 155).otherwise(part % 12) * F.lit(Decimal("0.1"))
        # The zone of a customer or supplier is put together once, not per line item.
        origins = self.read("supplier").select("s_suppkey", _zone("s_nationkey", "s_suppkey").alias("origin"))
        targets = self.read("customer").select("c_custkey", _zone("c_nationkey", "c_custkey").alias("target"))
        # Orders meet their customers first, so that the line items are only
        # shuffled by order and supplier.
        placed = self.read("orders").join(targets, F.col("o_custkey") == F.col("c_custkey"))
        joined = (
            self.read("lineitem")
            .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(origins, F.col("l_suppkey") == F.col("s_suppkey"))
        )
        return joined.select(
            F.when(key % 97 != 0, F.when(F.col("l_suppkey") % 7 == 3, "FR 20").otherwise(F.col("origin"))).alias("zc_from"),
            F.when(key % 89 != 0, F.when(F.col("o_custkey") % 11 == 5, "DE 01").otherwise(F.col("target"))).alias("zc_to"),
            F.when(part % 101 != 0, F.col("l_shipdate").cast("date")).alias("ship_date"),
            F.when((line == 7) & (part % 3 == 0), F.lit(None).cast("decimal(18,3)"))
            .when(empty, _decimal(0))
            .otherwise(_decimal(quantity))
            .alias("kg"),
            F.when(empty & (F.col("l_suppkey") % 2 == 0), _decimal(0)).otherwise(_decimal(metres)).alias("ldm"),
            F.when(empty, _decimal(0)).otherwise(_decimal(F.col("l_orderkey") % 40 * F.lit(Decimal("0.05")))).alias("m3"),
            F.when(part % 17 != 0, F.col("o_orderpriority")).alias("branch"),
            F.col("l_returnflag").alias("category1"),
            F.col("l_linestatus").alias("category2"),
        )

    @cached_property
    def clean(self) -> DataFrame:
        return clean_shipments(self.raw)

    @cached_property
    def shipments(self) -> DataFrame:
        return enrich_shipments(self.clean, self.params)

    @cached_property
    def dated(self) -> DataFrame:
        return self.shipments.filter("ship_date is not null")

    @cached_property
    def summary(self) -> DataFrame:
        return summary_rows(self.shipments)

    @cached_property
    def bridge(self) -> DataFrame:
        """Zone to region: 1, 2 or 4 regions per zone, none for zones ending in 9."""
        codes = self.read("nation").select(_code("n_nationkey").alias("n_code"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("z"))
        zones = codes.select(
            F.when(F.col("n_code") == "GB", "UK").otherwise(F.col("n_code")).alias("code"),
            "z",
            F.col("n_code").isin(*COLLAPSED_COUNTRIES).alias("collapsed"),
        ).filter((F.col("z") % 10 != 9) & (~F.col("collapsed") | (F.col("z") == 0)))
        entries = F.when(F.col("z") % 3 == 0, 1).when(F.col("z") % 3 == 1, 2).otherwise(4)
        listed = zones.withColumn("seq", F.explode(F.sequence(F.lit(0), entries - 1)))
        nuts1 = F.concat("code", (F.col("z") % 2).cast("string"))
        nuts2 = F.concat(nuts1, (F.col("seq") % 2).cast("string"))
        return listed.select(
            F.when(F.col("collapsed"), F.col("code"))
            .otherwise(F.concat_ws(" ", "code", _two_digits(F.col("z"))))
            .alias("zone"),
            F.col("code").alias("nuts0"),
            nuts1.alias("nuts1"),
            nuts2.alias("nuts2"),
            F.concat(nuts2, F.when(F.col("seq") >= 2, "1").otherwise("0")).alias("nuts3"),
            "seq",
        )

    @cached_property
    def regions(self) -> DataFrame:
        """Attributes of the regions of all levels; PL has none."""
        levels = [F.struct(F.lit(n).alias("lvl"), F.col(f"nuts{n}").alias("region_id")) for n in range(4)]
        listed = self.bridge.select(F.inline(F.array(*levels))).distinct()
        return listed.filter(F.substring("region_id", 1, 2) != "PL").select(
            "lvl",
            "region_id",
            F.concat(F.lit("Region "), "region_id").alias("name"),
            (F.length("region_id") + 40).cast("double").alias("lat"),
            (F.ascii("region_id") - 60).cast("double").alias("lon"),
        )

    @cached_property
    def outlines(self) -> DataFrame:
        """The catchment of each customer: a square, a triangle, a square with a hole, or two parts."""
        key = F.col("c_custkey")
        corner = [
            F.struct(*[F.lit(v).alias(n) for n, v in zip(("part", "ring", "seq", "dx", "dy"), c)]) for c in CORNERS
        ]
        listed = self.read("customer").select("c_custkey", F.inline(F.array(*corner)))
        outer = (F.col("part") == 0) & (F.col("ring") == 0)
        kept = listed.filter(
            ~(outer & (F.col("seq") == 3) & (key % 3 == 0))
            & ((F.col("ring") == 0) | (key % 3 == 2))
            & ((F.col("part") == 0) | (key % 4 == 1))
        )
        return kept.select(
            _region(key).alias("region_id"),
            "part",
            "ring",
            "seq",
            ((key % 360 - 180).cast("double") + F.col("dx")).alias("lon"),
            ((key % 140 - 70).cast("double") + F.col("dy")).alias("lat"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """The outlines as GeoJSON features, each region listed twice."""
        point = F.struct("seq", F.array("lon", "lat").alias("at"))
        rings = self.outlines.groupBy("region_id", "part", "ring").agg(_in_order(point, "at").alias("points"))
        parts = rings.groupBy("region_id", "part").agg(_in_order(F.struct("ring", "points"), "points").alias("rings"))
        whole = parts.groupBy("region_id").agg(_in_order(F.struct("part", "rings"), "rings").alias("parts"))
        single = F.size("parts") == 1
        geometry = F.struct(
            F.when(single, "Polygon").otherwise("MultiPolygon").alias("type"),
            F.when(single, F.to_json(F.col("parts")[0])).otherwise(F.to_json("parts")).alias("coordinates"),
        )
        again = F.struct(F.lit("Polygon").alias("type"), F.lit("[[[0.0,0.0]]]").alias("coordinates"))
        listed = F.array(
            F.struct(F.lit(0).alias("seq"), geometry.alias("geometry")),
            F.struct(F.lit(1).alias("seq"), again.alias("geometry")),
        )
        properties = F.create_map(F.lit("NUTS_ID"), F.col("region_id"))
        return whole.select(properties.alias("properties"), F.inline(listed)).select("properties", "geometry", "seq")

    @cached_property
    def catchments(self) -> DataFrame:
        """The zone of each customer with one to three regions, the last one listed first."""
        key = F.col("c_custkey")
        listed = self.read("customer").select(
            "c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0).cast("bigint"), key % 3)).alias("back")
        )
        return listed.select(
            F.concat_ws(" ", _code("c_nationkey"), _nine_digits(key)).alias("zone"),
            _region(F.greatest(key - F.col("back"), F.lit(0).cast("bigint"))).alias("nuts3"),
            (key % 3 - F.col("back")).cast("int").alias("seq"),
        )

    @cached_property
    def name_table(self) -> DataFrame:
        """One row of names per customer; the country's own name comes back again and again."""
        named = self.country_table.select(F.col("ord").alias("nation"), "iso2", "country_1")
        joined = self.read("customer").join(named, F.col("c_nationkey") == F.col("nation"))
        return joined.select(
            F.col("c_custkey").alias("ord"),
            "iso2",
            "country_1",
            F.lower("c_name").alias("country_2"),
            F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("republic of "), "country_1")).alias("country_3"),
            F.lit(None).cast("string").alias("country_4"),
        )

    @cached_property
    def branches(self) -> DataFrame:
        code, number = _code("s_nationkey"), F.col("s_suppkey")
        return self.read("supplier").select(
            code.alias("country"),
            (number % 20 + 40).cast("double").alias("lat"),
            (number % 30 - 5).cast("double").alias("lon"),
            F.col("s_name").alias("office_name"),
            _zone("s_nationkey", "s_suppkey").alias("zone"),
            F.concat(F.lit("+00 "), F.lpad(number.cast("string"), 6, "0")).alias("phone"),
            F.lit("08:00-18:00").alias("opening_hours"),
        )

    @cached_property
    def country_table(self) -> DataFrame:
        """Country names in four columns; the last one is empty."""
        name = F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), F.col("n_nationkey") + 1)
        named = self.read("nation").select("n_nationkey", _code("n_nationkey").alias("iso2"), name.alias("country_1"))
        return named.select(
            F.col("n_nationkey").alias("ord"),
            "iso2",
            "country_1",
            F.lower("iso2").alias("country_2"),
            F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("republic of "), "country_1")).alias("country_3"),
            F.lit(None).cast("string").alias("country_4"),
        )

    @cached_property
    def postal(self) -> DataFrame:
        """A hundred postal zones per country, none for XK."""
        listed = self.country_table.filter("iso2 <> 'XK'").withColumn(
            "ord", F.explode(F.sequence(F.lit(0), F.lit(99)))
        )
        zone = F.concat_ws(" ", "iso2", _two_digits(F.col("ord")))
        return listed.select(
            F.col("iso2").alias("country"), F.concat(zone, F.lit("000")).alias("full_zc"), zone.alias("zc"), "ord"
        )

    @cached_property
    def customer_zones(self) -> DataFrame:
        """A reference zone of its own for each customer."""
        zone = F.concat_ws(" ", _code("c_nationkey"), _nine_digits(F.col("c_custkey")))
        return self.read("customer").select(
            _code("c_nationkey").alias("country"), zone.alias("full_zc"), zone.alias("zc"), F.col("c_custkey").alias("ord")
        )

    @cached_property
    def bid(self) -> DataFrame:
        """A messy tender file: one row per customer."""
        key, blank = F.col("c_custkey"), F.col("c_custkey") % 50 == 0
        origin = self.country_table.select(
            F.col("ord").alias("o_ord"), F.col("country_1").alias("o_name"), F.col("iso2").alias("o_iso")
        )
        target = self.country_table.select(F.col("ord").alias("t_ord"), F.col("country_1").alias("t_name"))
        joined = (
            self.read("customer")
            .join(origin, F.col("c_nationkey") == F.col("o_ord"))
            .join(target, (F.col("c_nationkey") * 7 + 3) % 25 == F.col("t_ord"))
        )

        def gapped(name: str) -> Column:
            return F.concat(F.substring(name, 1, 2), F.expr(f"substring({name}, 4)"))

        def digits(factor: int) -> Column:
            return F.lpad((key * factor % 100000).cast("string"), 5, "0")

        return joined.select(
            F.col("c_custkey").alias("row_id"),
            F.when(
                ~blank,
                F.when(key % 5 == 0, F.col("o_name"))
                .when(key % 5 == 1, F.upper("o_name"))
                .when(key % 5 == 2, gapped("o_name"))
                .when(key % 5 == 3, F.col("o_iso"))
                .otherwise(F.concat("o_name", F.lit("  "))),
            ).alias("Collection country"),
            F.when(
                ~blank & (key % 8 != 3),
                F.when(key % 4 == 1, F.concat(digits(37), F.lit(".0")))
                .when(key % 4 == 2, F.concat(F.lit("F-"), digits(37)))
                .otherwise(digits(37)),
            ).alias("Collection zipcode"),
            F.when(
                ~blank,
                F.when(key % 3 == 0, F.col("t_name")).when(key % 3 == 1, F.upper("t_name")).otherwise(gapped("t_name")),
            ).alias("Delivery country"),
            F.when(~blank, digits(53)).alias("Delivery zipcode"),
            F.when(~blank, F.col("c_mktsegment")).alias("Goods"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Answers with 31 to 80 lines, so most are longer than the block of questions."""
        size = F.col("p_size")
        items = F.transform(
            F.sequence(F.lit(1), size + 24),
            lambda i: F.concat(F.lit("- Item "), i.cast("string"), F.lit(": "), F.col("p_brand"), F.lit(": no. "), (i * size).cast("string")),
        )
        verdict = F.when(size % 2 == 0, "Go: none").otherwise("NoGo: penalties")
        lines = [
            F.concat(F.lit("Summary of "), "p_name"),
            F.lit(""),
            F.concat(F.lit("- Customer name: "), "p_brand"),
            F.concat(F.lit("- Sector: "), "p_type", F.lit(": size "), size.cast("string")),
            F.lit("- no colon here"),
            F.array_join(items, "\n"),
            F.concat(F.lit("- Go/NoGo: "), verdict),
        ]
        return self.read("part").select(F.col("p_partkey").alias("answer_id"), F.concat_ws("\n", *lines).alias("text"))
