"""What the physical plans must and must not contain."""

import contextlib
import io
from datetime import date

import pytest
from pyspark.sql import functions as F

from lanewise.operators import answers, clean, collection, enrich, facets, profile, regions, regularity, summary
from lanewise.plans import catalog
from lanewise.plans.tables import Tables
from lanewise.schema import MEASURES, SHIPMENT_SCHEMA
from lanewise.sources import files, sinks

FOLDER = "/root/testdata/sf0.001"
# These build their result from tables they write first.
WRITING = {"export_table", "export_tables", "fuzzy_country", "fuzzy_zone", "match_score", "bid_zone_pairs", "prefix_zone"}
WRITING |= {"read_bridge", "read_offices", "read_country_names", "read_postal", "read_regions", "bid_without_roles", "bid_part_mapping", "fuzzy_customer_zone", "bid_corrected"}


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(set(catalog.REPORTS) - WRITING))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(catalog.queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "ArrowEvalPython"):
        assert node not in plan


@pytest.fixture(scope="module")
def stored_shipments(spark, tmp_path_factory):
    raw = Tables(spark, FOLDER).raw.withColumn("month", F.date_format("ship_date", "yyyy-MM"))
    path = str(tmp_path_factory.mktemp("shipments") / "table")
    sinks.write_table(raw, path, partition_by=["month"])
    return path


def test_scan_reads_only_what_is_needed(spark, stored_shipments):
    ships = enrich.enrich_shipments(clean.clean_shipments(files.read_shipments(spark, stored_shipments)))
    counted = ships.groupBy("zc_to").agg(F.count("zc_from").alias("n"))
    plan = plan_of(counted)
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "IsNotNull(zc_from)" in plan and "IsNotNull(zc_to)" in plan
    assert "branch" not in schema and "ship_date" not in schema


def test_known_complete_dates_reach_the_scan(spark, stored_shipments):
    ships = files.read_table(spark, stored_shipments)
    period = (date(1996, 1, 1), date(1996, 6, 30))
    plan = plan_of(facets.date_range_filter(ships, period, dates_complete=True))
    assert "GreaterThanOrEqual(ship_date,1996-01-01)" in plan
    months = plan_of(ships.filter(F.col("month").between("1996-01", "1996-06")))
    assert "PartitionFilters: [isnotnull(month" in months


@pytest.mark.parametrize("build", [regularity.regularity, summary.top_lanes, summary.way_product])
def test_one_shuffle_of_shipments(spark, build):
    rows = enrich.enrich_shipments(spark.createDataFrame([], SHIPMENT_SCHEMA))
    assert plan_of(build(rows)).count("Exchange hashpartitioning") == 1


def test_share_of_lanes_shuffles_once(spark):
    shares = profile.lane_profile(Tables(spark, FOLDER).shipments)
    shares.collect()
    assert "ReusedExchange [zc_from" in plan_of(shares)


def test_lanes_of_the_pareto_report_move_once(spark):
    plan = plan_of(summary.lane_pareto(Tables(spark, FOLDER).summary))
    assert plan.count("Exchange hashpartitioning(zc_from") <= 2 and "Exchange hashpartitioning(shipments" in plan
    assert "SortMergeJoin [shipments" not in plan and "_salt" not in plan


def test_answer_lines_are_split_once(spark):
    """Of answers longer than the questions, every line with a colon comes out of one of the three tables."""
    texts = Tables(spark, FOLDER).answers
    parts = [answers.answer_lines, answers.fuel_lines, answers.verdict_line]
    counts = [part(texts, "answer_id").groupBy("answer_id").agg(F.count(F.lit(1)).alias("n")) for part in parts]
    found = {}
    for count in counts:
        for r in count.collect():
            found[r.answer_id] = found.get(r.answer_id, 0) + r.n
    for r in texts.collect():
        lines = r.text.split("\n")
        if len(lines) > answers.QUESTION_LINES:
            assert found[r.answer_id] == sum(": " in line[1:] for line in lines)
    assert counts[1].count() > 0


def test_row_operators_take_a_stream(spark, stored_shipments, tmp_path):
    schema = files.read_table(spark, stored_shipments).schema
    stream = spark.readStream.schema(schema).parquet(stored_shipments)
    ships = enrich.enrich_shipments(clean.clean_shipments(stream))
    query = ships.writeStream.format("memory").queryName("ships").option(
        "checkpointLocation", str(tmp_path / "state")
    ).start()
    query.processAllAvailable()
    query.stop()
    batch = clean.clean_shipments(files.read_table(spark, stored_shipments))
    assert spark.table("ships").count() == batch.count()


def test_parts_add_up(spark):
    tables = Tables(spark, FOLDER)
    assert tables.clean.count() + clean.rejected_rows(tables.raw).count() == tables.raw.count()
    lanes = profile.lane_profile(tables.shipments).agg(F.sum("total"), *[F.sum(c) for c in profile.COLUMNS]).first()
    assert lanes[0] == sum(lanes[1:]) == tables.shipments.filter("pay_weight is not null").count()


def test_regions_and_unmapped_zones_add_up(spark):
    tables = Tables(spark, FOLDER)
    zones = regions.zone_values(tables.shipments, "zc_to")
    split = regions.split_over_regions(zones, tables.bridge, 3).agg(F.sum("value")).first()[0]
    unmapped = zones.join(tables.bridge, "zone", "left_anti").agg(F.sum("value")).first()[0]
    assert split + unmapped == zones.agg(F.sum("value")).first()[0] and unmapped > 0


def test_weekdays_and_days_add_up(spark):
    ships = Tables(spark, FOLDER).shipments
    week = collection.weekday_totals(ships).agg(F.sum("shipments"), F.sum("kg"), F.sum("collections")).first()
    days = collection.daily_totals(ships).agg(F.sum("shipments"), F.sum("kg"), F.count("ship_date")).first()
    assert tuple(week) == tuple(days)


def test_measures_of_any_type(spark):
    doubles = Tables(spark, FOLDER).raw.withColumns({m: F.col(m).cast("double") for m in MEASURES})
    text = doubles.withColumns({m: F.col(m).cast("string") for m in MEASURES})
    counts = [
        summary.way_product(summary.summary_rows(enrich.enrich_shipments(clean.clean_shipments(df)))).orderBy("way").collect()
        for df in (Tables(spark, FOLDER).raw, doubles, text)
    ]
    assert counts[0] == counts[1] == counts[2]
