"""Every report by name, as a function of the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.operators import answers, bids, clean, collection, enrich, facets, profile, regions, regularity, summary
from lanewise.plans.tables import Tables
from lanewise.schema import (
    BRIDGE_HEADERS,
    COUNTRY_PROPERTIES,
    MEASURES,
    NAME_HEADERS,
    OFFICE_HEADERS,
    POSTAL_HEADERS,
    SHIPMENT_HEADERS,
    Params,
)
from lanewise.sources import files, sinks
from lanewise.storage import shared_folder

Report = Callable[[Tables], DataFrame]
REPORTS: dict[str, Report] = {}

ENRICHED = ("zc_from", "zc_to", "cntry_from", "cntry_to", "way", "pay_weight", "bracket", "product")
ORIGIN = "FR 20"
DESTINATION = "DE 01"
PERIOD = (date(1996, 1, 1), date(1998, 12, 31))
UNREADABLE = ("12 kg", "12d", "12f", "Infinity", "-Infinity", "1e400", "  ", "NaN", "0x1F", "1.2.3")


def report(name: str) -> Callable[[Report], Report]:
    def add(build: Report) -> Report:
        REPORTS[name] = build
        return build

    return add


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _enriched(df: DataFrame, *more: str) -> DataFrame:
    return _doubles(df.select(*ENRICHED, *more), "pay_weight")


# Sources and sinks


@report("shipments_source")
def _(t: Tables) -> DataFrame:
    as_file = t.raw.withColumnsRenamed({ours: header for header, ours in SHIPMENT_HEADERS.items()})
    return _doubles(files.select_shipments(as_file.withColumn("remark", F.lit("x"))), *MEASURES)


@report("shipments_source_plain")
def _(t: Tables) -> DataFrame:
    return _doubles(files.select_shipments(t.raw.drop("ship_date", "category2")), *MEASURES)


REPORTS["region_vertices"] = lambda t: files.region_vertices(t.features, "NUTS_ID")
REPORTS["branch_points"] = lambda t: files.branch_points(t.branches)
REPORTS["branch_countries"] = lambda t: files.branch_countries(t.branches)
REPORTS["bid_source"] = lambda t: files.trim_headers(t.bid.withColumnRenamed("Goods", "Goods "))
REPORTS["bid_head_csv"] = lambda t: bids.bid_head_csv(_bid_cells(t), "row_id", keep=["row_id"])


@report("export_table")
def _(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/rejected-{uuid.uuid4().hex}"
    sinks.write_table(clean.rejected_rows(t.raw), path)
    return _doubles(files.read_table(t.spark, path), *MEASURES)


@report("export_tables")
def _(t: Tables) -> DataFrame:
    sheets = {
        "rejected": clean.rejected_rows(t.raw),
        "ways": summary.shipments_by_way(t.summary),
        "brackets": summary.shipments_by_bracket(t.summary),
        "branches": files.branch_points(t.branches),
        "months": summary.seasonality(t.summary),
    }
    path = f"{shared_folder(t.spark)}/sheets-{uuid.uuid4().hex}"
    sinks.write_tables(sheets, path)
    rows = [_cells(name, table) for name, table in files.read_tables(t.spark, path).items()]
    return reduce(DataFrame.unionAll, rows)


def _cells(name: str, table: DataFrame) -> DataFrame:
    """Rows of a table as its texts and its numbers, each in the order of their columns' names."""
    kinds = dict(sorted(table.dtypes))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c, kind in kinds.items() if kind in ("string", "date")]
    numbers = [F.col(c).cast("double") for c, kind in kinds.items() if kind not in ("string", "date")]
    padded = [*numbers, *[F.lit(None).cast("double")] * (4 - len(numbers))]
    columns = [n.alias(f"number{i}") for i, n in enumerate(padded, 1)]
    return table.select(F.lit(name).alias("name"), F.concat_ws("|", *texts).alias("texts"), *columns)


# Reference tables, from files with the headers they come with


def _as_file(t: Tables, df: DataFrame, headers: dict[str, str], order: list[str]) -> str:
    renamed = df.orderBy(*order).select(*[F.col(ours).alias(header) for header, ours in headers.items()])
    path = f"{shared_folder(t.spark)}/reference-{uuid.uuid4().hex}"
    return sinks.write_table(renamed.withColumn("remark", F.lit("x")), path, "csv")


@report("read_bridge")
def _(t: Tables) -> DataFrame:
    bridge = files.read_bridge(t.spark, _as_file(t, t.bridge, BRIDGE_HEADERS, ["zone", "seq"]))
    first = bridge.groupBy("zone").agg(F.min_by("nuts3", "seq").alias("first_nuts3"), F.count("nuts0").alias("rows"))
    return first


@report("read_offices")
def _(t: Tables) -> DataFrame:
    return files.read_offices(t.spark, _as_file(t, t.branches, OFFICE_HEADERS, ["office_name"]))


@report("read_country_names")
def _(t: Tables) -> DataFrame:
    names = files.read_country_names(t.spark, _as_file(t, t.name_table, NAME_HEADERS, ["ord"]))
    return bids.country_names(names).drop("ord")


@report("read_postal")
def _(t: Tables) -> DataFrame:
    """All rows, each with its place among those of its country."""
    postal = files.read_postal(t.spark, _as_file(t, t.customer_zones, POSTAL_HEADERS, ["ord"]))
    place = F.row_number().over(Window.partitionBy("country").orderBy("ord"))
    return postal.select("country", "full_zc", "zc", place.alias("place"))


@report("read_regions")
def _(t: Tables) -> DataFrame:
    id_, name, lat, lon = COUNTRY_PROPERTIES
    properties = F.create_map(
        F.lit(id_), "region_id", F.lit(name), "name", F.lit(lat), F.col("lat").cast("string"), F.lit(lon), F.col("lon").cast("string")
    )
    path = f"{shared_folder(t.spark)}/regions-{uuid.uuid4().hex}"
    sinks.write_table(t.regions.filter("lvl = 0").select(properties.alias("properties")), path, "json")
    return files.region_attributes(files.read_features(t.spark, path, lines=True), 0, id_, name, lat, lon)


# Cleaning and enrichment

REPORTS["clean_shipments"] = lambda t: _doubles(t.clean, *MEASURES)
REPORTS["rejected_rows"] = lambda t: _doubles(clean.rejected_rows(t.raw), *MEASURES)
REPORTS["rejected_count"] = lambda t: clean.rejected_count(t.raw)


@report("zone_normalise")
def _(t: Tables) -> DataFrame:
    zones = t.raw.select(F.explode(F.array("zc_from", "zc_to")).alias("zone"))
    counted = zones.groupBy("zone").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("normalised", clean.normalise_zone("zone"))


@report("coerce_types")
def _(t: Tables) -> DataFrame:
    """Line items with their numbers and dates as text, some of them unreadable."""
    line, part, ship = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_shipdate")
    odd = F.element_at(F.array(*[F.lit(x) for x in UNREADABLE]), (part % len(UNREADABLE) + 1).cast("int"))
    quantity = F.col("l_quantity").cast("string")
    # With slashes the day comes first where only that reading is a date.
    slashes = F.when(F.dayofmonth(ship) > 12, F.date_format(ship, "dd/MM/yyyy")).otherwise(F.date_format(ship, "M/d/yyyy"))
    dates = (
        F.when(line == 2, "soon")
        .when(part % 5 == 0, F.date_format(ship, "dd.MM.yyyy"))
        .when(part % 5 == 1, slashes)
        .when(part % 5 == 2, F.date_format(ship, "MM/dd/yyyy"))
        .when(part % 5 == 3, F.date_format(ship, " d-M-yyyy "))
        .otherwise(F.date_format(ship, "yyyy-MM-dd"))
    )
    text = t.read("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(line == 3, odd).when(line == 1, F.concat(F.lit(" "), quantity, F.lit("e1 "))).otherwise(quantity).alias("kg"),
        F.col("l_discount").cast("string").alias("ldm"),
        F.when(line == 4, "NaN").otherwise(F.col("l_tax").cast("string")).alias("m3"),
        dates.alias("ship_date"),
    )
    return clean.coerce_types(text, by_column=False)


def _dates_with_slashes(t: Tables, order: str) -> DataFrame:
    """Ship dates as text in one order, some unreadable; most could be read in the other order as well, or not at all."""
    ship = F.when(F.col("l_linenumber") == 2, "soon").otherwise(F.date_format("l_shipdate", order))
    measures = [F.lit(1.0).alias(m) for m in MEASURES]
    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", ship.alias("ship_date"), *measures)
    return clean.coerce_types(rows).select("l_orderkey", "l_linenumber", "ship_date")


REPORTS["dates_day_first"] = lambda t: _dates_with_slashes(t, "d/M/yyyy")
REPORTS["dates_month_first"] = lambda t: _dates_with_slashes(t, "MM/dd/yyyy")


REPORTS["enrich_shipments"] = lambda t: _enriched(t.shipments)
REPORTS["enrich_home_gb"] = (
    lambda t: enrich.enrich_shipments(t.clean, Params(home="GB"))
    .groupBy("way", "product")
    .agg(F.count(F.lit(1)).alias("shipments"))
)
REPORTS["enrich_with_factor"] = lambda t: _enriched(
    enrich.enrich_shipments(t.clean, Params(ldm_factor=1750)), "ldm", "ldm_eq"
)
REPORTS["lane_key"] = lambda t: t.shipments.groupBy(enrich.lane_key().alias("lane")).agg(
    F.count(F.lit(1)).alias("shipments")
)


@report("format_thousands")
def _(t: Tables) -> DataFrame:
    from lanewise.functions.numbers import thousands

    return t.shipments.groupBy("zc_from").agg(F.sum("kg").alias("kg")).withColumn("kg", thousands("kg"))


# Facets

REPORTS["facet_filter"] = lambda t: _enriched(
    facets.facet_filter(
        t.shipments.drop("category2"), {"cntry_from": ["FR", "DE", "IT"], "product": ["GRP", "LTL"]}
    ),
    "branch",
)
REPORTS["facet_filter_categories"] = lambda t: _enriched(
    facets.facet_filter(
        t.shipments, {"cntry_from": ["FR", "DE", "IT"], "category1": ["A", "N"], "way": ["Exp", "X-trade"]}
    ),
    "branch",
    "category1",
    "category2",
)
REPORTS["date_range_filter"] = lambda t: _doubles(
    facets.date_range_filter(t.shipments.filter("ship_date is not null"), PERIOD).select(
        "zc_from", "zc_to", "ship_date", "kg"
    ),
    "kg",
)
REPORTS["date_range_off"] = (
    lambda t: facets.date_range_filter(t.shipments, PERIOD).groupBy("zc_from").agg(F.count(F.lit(1)).alias("shipments"))
)
REPORTS["date_bounds"] = lambda t: facets.date_bounds(t.shipments)
REPORTS["facet_options"] = lambda t: facets.facet_options(
    t.shipments, {"branch": ["1-URGENT", "2-HIGH"], "cntry_from": ["FR", "DE"]}
)
REPORTS["map_filter"] = lambda t: _enriched(
    facets.map_filter(t.shipments, {"product": ["LTL", "FTL"], "branch": ["3-MEDIUM"]}, PERIOD)
)
REPORTS["map_filter_dates"] = lambda t: _enriched(
    facets.map_filter(t.dated, {"product": ["LTL", "FTL"], "branch": ["3-MEDIUM"]}, PERIOD), "ship_date"
)
REPORTS["facet_filter_dates"] = lambda t: _enriched(
    facets.facet_filter(t.dated.drop("category2"), {"product": ["GRP", "LTL"]}, dates=PERIOD), "ship_date"
)
REPORTS["facet_filter_dates_off"] = lambda t: _enriched(
    facets.facet_filter(t.shipments.drop("category2"), {"product": ["GRP", "LTL"]}, dates=PERIOD)
)
REPORTS["zone_list"] = lambda t: facets.zone_list(t.shipments)

# Summary

REPORTS["summary_way"] = lambda t: summary.shipments_by_way(t.summary)
REPORTS["summary_product_count"] = lambda t: summary.shipments_by_product(t.summary)
REPORTS["summary_bracket"] = lambda t: summary.shipments_by_bracket(t.summary)
REPORTS["top_delivery"] = lambda t: summary.top_delivery(t.summary)
REPORTS["top_collection"] = lambda t: summary.top_collection(t.summary)
REPORTS["top_lanes"] = lambda t: summary.top_lanes(t.summary)
REPORTS["seasonality"] = lambda t: summary.seasonality(t.summary)
REPORTS["product_matrix"] = lambda t: summary.product_matrix(t.summary)
REPORTS["way_product"] = lambda t: summary.way_product(t.summary)
REPORTS["lane_pareto"] = lambda t: summary.lane_pareto(t.summary)

# Lane profile

REPORTS["lane_profile"] = lambda t: profile.lane_profile(t.shipments)
REPORTS["profile_totals"] = lambda t: profile.profile_totals(t.shipments)
REPORTS["profile_extents"] = lambda t: profile.profile_extents(t.shipments)
REPORTS["profile_bands"] = lambda t: profile.profile_bands(t.shipments)
REPORTS["profile_bracket_bands"] = lambda t: profile.profile_bracket_bands(t.shipments)

# Collection

REPORTS["daily_totals"] = lambda t: collection.daily_totals(t.shipments)
REPORTS["weekday_totals"] = lambda t: collection.weekday_totals(t.shipments)
REPORTS["collection_totals"] = lambda t: collection.collection_totals(t.shipments)
REPORTS["daily_describe"] = lambda t: _rounded(
    collection.daily_describe(t.shipments), "mean", "std", "p25", "p50", "p75"
)
REPORTS["working_days"] = lambda t: collection.working_days(t.shipments)
REPORTS["ldm_buckets"] = lambda t: collection.ldm_buckets(t.shipments)
REPORTS["ldm_buckets_by_lane"] = lambda t: collection.ldm_buckets(
    facets.facet_filter(t.shipments, {"zc_from": [ORIGIN]})
)
REPORTS["collection_seasonality"] = lambda t: collection.collection_seasonality(t.shipments)

# Regions

REPORTS["region_delivery"] = lambda t: _rounded(regions.region_delivery(t.shipments, t.bridge), "value")
REPORTS["region_collection"] = lambda t: _rounded(regions.region_collection(t.shipments, t.bridge), "value")


def _by_level(level: int) -> Report:
    return lambda t: _rounded(
        regions.attach_regions(regions.region_delivery(t.shipments, t.bridge, level), t.regions, level), "value"
    )


REPORTS["region_join"] = lambda t: _by_level(0)(t).filter("name is null")
for _level in range(4):
    REPORTS[f"region_by_level_{_level}"] = _by_level(_level)


def _outbound(variable: str) -> Report:
    return lambda t: _rounded(
        regions.outbound_map(t.shipments, t.bridge, t.regions, ORIGIN, level=1, variable=variable), "value"
    )


for _variable in ("pay_weight", "kg", "ldm", "m3"):
    REPORTS[f"outbound_{_variable}"] = _outbound(_variable)
REPORTS["outbound_map"] = lambda t: _rounded(
    regions.outbound_map(t.shipments, t.bridge, t.regions, ORIGIN, level=2), "value"
)
REPORTS["inbound_map"] = lambda t: _rounded(
    regions.inbound_map(t.shipments, t.bridge, t.regions, DESTINATION, level=2), "value"
)
REPORTS["inbound_kg"] = lambda t: _rounded(
    regions.inbound_map(t.shipments, t.bridge, t.regions, DESTINATION, level=1, variable="kg"), "value"
)
REPORTS["top_zones_by_variable"] = lambda t: regions.top_zones_by_variable(t.shipments, "zc_from", "ldm")
REPORTS["top_zones_by_shipments"] = lambda t: regions.top_zones_by_variable(t.shipments, "zc_to")
REPORTS["marker_radius"] = lambda t: _rounded(
    regions.marker_radius(regions.region_collection(t.shipments, t.bridge)), "value", "radius"
)
REPORTS["region_centroid"] = lambda t: _rounded(regions.region_centroid(t.outlines), "lon", "lat")
REPORTS["zone_anchor"] = lambda t: regions.zone_anchor(t.catchments)
REPORTS["zone_centroid"] = lambda t: _rounded(regions.zone_centroid(t.catchments, t.outlines), "lon", "lat")

# Regularity

REPORTS["regularity"] = lambda t: regularity.regularity(t.shipments)
REPORTS["weekly_trend"] = lambda t: regularity.weekly_trend(t.shipments).withColumn(
    "trend", F.array_join(F.col("trend").cast("array<string>"), ",")
)
REPORTS["regularity_band"] = lambda t: regularity.regularity_band(t.shipments)

# Tender files


def _bid_cells(t: Tables) -> DataFrame:
    return bids.normalise_bid(t.bid, keep=["row_id"])


def _names(t: Tables) -> DataFrame:
    return bids.country_names(t.country_table)


def _coded_bid(t: Tables) -> DataFrame:
    """Tender rows with a country code that does not depend on a match."""
    codes = t.country_table.select(F.col("ord"), "iso2")
    return t.bid.join(codes, F.col("row_id") % 25 == F.col("ord")).drop("ord")


REPORTS["bid_normalise"] = _bid_cells
REPORTS["column_role_profile"] = lambda t: bids.column_profile(_bid_cells(t), _names(t), keep=["row_id"])
REPORTS["column_roles"] = lambda t: bids.column_roles(bids.column_profile(_bid_cells(t), _names(t), keep=["row_id"]))
REPORTS["bid_feasible"] = lambda t: bids.bid_feasible(
    bids.column_roles(bids.column_profile(_bid_cells(t), _names(t), keep=["row_id"]))
)
REPORTS["country_names_long"] = lambda t: bids.country_names(t.name_table)


@report("fuzzy_country")
def _(t: Tables) -> DataFrame:
    cells = _bid_cells(t)
    texts = cells.select(F.explode(F.array("Collection country", "Delivery country")).alias("text"))
    return bids.fuzzy_country(texts, _names(t))


REPORTS["clean_zip"] = lambda t: _coded_bid(t).select(
    "row_id",
    F.col("iso2").alias("iso"),
    F.col("Collection zipcode").alias("zip"),
    bids.clean_zip(F.col("Collection zipcode"), F.col("iso2")).alias("cleaned"),
)
REPORTS["compose_zone"] = lambda t: _coded_bid(t).select(
    "row_id", bids.compose_zone(F.col("iso2"), F.col("Delivery zipcode")).alias("zone")
)
REPORTS["short_zone"] = lambda t: _coded_bid(t).select(
    "row_id", bids.short_zone(F.col("iso2"), F.col("Delivery zipcode")).alias("zone")
)


@report("pad_zip")
def _(t: Tables) -> DataFrame:
    """Postal codes of both ends, without the zeros that a spreadsheet takes off."""
    ends = F.array(F.struct(F.lit("from").alias("end"), F.col("Collection zipcode").alias("text")),
                   F.struct(F.lit("to").alias("end"), F.col("Delivery zipcode").alias("text")))
    cells = _coded_bid(t).select("row_id", "iso2", F.inline(ends))
    code = F.regexp_replace(bids.clean_zip(F.col("text"), F.col("iso2")), "^0+", "")
    short = cells.withColumn("zip", code)
    return short.select("row_id", "end", "zip", bids.pad_zip(F.col("iso2"), F.col("zip")).alias("padded"))


MAPPING = {
    "origin_cntry": "Collection country",
    "origin_zipcode": "Collection zipcode",
    "destination_cntry": "Delivery country",
    "destination_zipcode": "Delivery zipcode",
}


@report("fuzzy_zone")
def _(t: Tables) -> DataFrame:
    ends = bids.coded_ends(bids.apply_roles(_bid_cells(t), MAPPING, keep=["row_id"]), _names(t))
    return bids.fuzzy_zone(ends.select(F.col("iso2").alias("country"), F.col("zone").alias("text")), t.postal)


@report("match_score")
def _(t: Tables) -> DataFrame:
    pairs = bids.bid_zone_pairs(t.bid, t.country_table, t.postal, MAPPING, keep=["row_id"], legacy_score=True)
    return pairs.select("row_id", "match_score", "needs_review", "review_flag")


@report("bid_zone_pairs")
def _(t: Tables) -> DataFrame:
    pairs = bids.bid_zone_pairs(t.bid, t.country_table, t.postal, keep=["row_id"])
    return pairs.drop(*bids.ROLES)


@report("column_assignment")
def _(t: Tables) -> DataFrame:
    """One column looks like countries more than like postal codes, and is needed for the codes nevertheless."""
    row, name = F.col("row_id"), _names(t).where("iso2 = 'FR'").agg(F.min("country")).scalar()
    code = F.lpad(row.cast("string"), 5, "0")
    file = t.bid.select(
        "row_id",
        F.when(row % 10 < 6, name).otherwise(code).alias("Collection 1"),
        F.when(row % 20 < 11, name).otherwise("n/a").alias("Collection 2"),
        F.when(row % 3 > 0, code).otherwise("n/a").alias("Delivery 1"),
        F.when(row % 4 > 0, code).otherwise("n/a").alias("Delivery 2"),
        name.alias("Delivery and collection"),
    )
    return bids.column_assignment(bids.column_profile(file, _names(t), keep=["row_id"]))


@report("bid_corrected")
def _(t: Tables) -> DataFrame:
    """Every seventh row gets another zone at its origin, every fourteenth one at both ends."""
    pairs = bids.bid_zone_pairs(t.bid, t.country_table, t.postal, keep=["row_id"])
    rows = t.bid.select("row_id").where("row_id % 7 = 0")
    origin = rows.select("row_id", F.lit("origin").alias("end"), F.lit("FR 99").alias("zc"))
    destination = rows.where("row_id % 14 = 0").select("row_id", F.lit("destination").alias("end"), F.lit("DE 99").alias("zc"))
    nothing = rows.select("row_id", F.lit("destination").alias("end"), F.lit(None).cast("string").alias("zc"))
    corrections = origin.unionByName(destination).unionByName(nothing)
    done = bids.apply_corrections(pairs, corrections, keep=["row_id"])
    return done.select("row_id", "origin_zc", "destination_zc", "match_score", "needs_review", "review_flag", "corrected")


@report("bid_next_file")
def _(t: Tables) -> DataFrame:
    """A file whose ends are partly known from another one: the first ends come from the dictionary, the others are matched."""
    known = f"{shared_folder(t.spark)}/ends-{uuid.uuid4().hex}"
    cells, names = bids.apply_roles(_bid_cells(t), MAPPING, keep=["row_id"]), _names(t)
    bids.known_ends(cells.withColumns({role: F.col(f"origin_{role.split('_')[1]}") for role in bids.ROLES}), names, t.postal, known)
    pairs = bids.bid_zone_pairs(t.bid, t.country_table, t.postal, MAPPING, keep=["row_id"], dictionary=known)
    return pairs.drop(*bids.ROLES)


@report("bid_without_roles")
def _(t: Tables) -> DataFrame:
    """A file whose headers name no end: nothing can be matched, and every row says so."""
    strange = t.bid.toDF("row_id", "LandVon", "PLZVon", "LandNach", "PLZNach", "Ware")
    pairs = bids.bid_zone_pairs(strange, t.country_table, t.postal, keep=["row_id"])
    return pairs.select("row_id", "origin_zc", "destination_zc", "match_score", "needs_review", "review_flag")


@report("bid_part_mapping")
def _(t: Tables) -> DataFrame:
    """One header that names no end, given by the user."""
    renamed = t.bid.withColumnRenamed("Collection zipcode", "PLZ 1")
    given = {"origin_zipcode": "PLZ 1"}
    pairs = bids.bid_zone_pairs(renamed, t.country_table, t.postal, given, keep=["row_id"])
    return pairs.select("row_id", "origin_zc", "destination_zc", "match_score", "review_flag")


@report("fuzzy_customer_zone")
def _(t: Tables) -> DataFrame:
    """Zones that lack a digit, against a list that grows with the customers."""
    gapped = F.concat(F.substring("full_zc", 1, 6), F.expr("substring(full_zc, 8)"))
    return bids.fuzzy_zone(t.customer_zones.select("country", gapped.alias("text")), t.customer_zones)


@report("prefix_zone")
def _(t: Tables) -> DataFrame:
    row, zipcode = F.col("row_id"), F.col("Delivery zipcode")
    text = F.when(row % 2 == 0, F.concat_ws(" ", "iso2", zipcode)).otherwise(F.concat_ws("-", "iso2", zipcode))
    keys = _coded_bid(t).filter(zipcode.isNotNull()).select(F.col("iso2").alias("country"), text.alias("text"))
    return bids.prefix_zone(keys, t.postal)


# Answers

REPORTS["answer_lines"] = lambda t: answers.answer_lines(t.answers, "answer_id")
REPORTS["fuel_lines"] = lambda t: answers.fuel_lines(t.answers, "answer_id")
REPORTS["verdict_line"] = lambda t: answers.verdict_line(t.answers, "answer_id")
REPORTS["summary_split"] = lambda t: answers.summary_split(t.answers, "answer_id")


@report("summary_split_conversations")
def _(t: Tables) -> DataFrame:
    turns = t.read("conversations").withColumn("key", F.struct("conv_id", "turn"))
    return answers.summary_split(turns, "key").select("key.*", "summary", "recommendations")


REPORTS["token_chunks"] = lambda t: answers.token_chunks(t.read("documents"), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(build: Report) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: run(build) for name, build in REPORTS.items()}
