"""Tender reports give the same result however Spark joins their match tables."""

from collections import Counter

import pytest

import compare
from lanewise.operators import bids
from lanewise.plans import catalog, oracle
from lanewise.plans.tables import Tables
from test_plans import plan_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["column_role_profile", "fuzzy_zone", "bid_zone_pairs", "prefix_zone"])
def test_without_broadcasts(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = catalog.queries()[name](spark, FOLDER)
        assert compare.differences(report, compare.connect(FOLDER), oracle.oracle_sql()[name]) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_place_holds_most_rows(spark):
    """Nine of ten rows name the same two ends: all get what one of them gets."""
    t = Tables(spark, FOLDER)
    one = t.bid.filter("row_id = 7")
    times = 9 * t.bid.count()
    copies = one.drop("row_id").crossJoin(spark.range(10_000, 10_000 + times).withColumnRenamed("id", "row_id"))
    bid = t.bid.unionByName(copies)
    pairs = bids.bid_zone_pairs(bid, t.country_table, t.postal, keep=["row_id"]).drop("row_id")
    plain = bids.bid_zone_pairs(t.bid, t.country_table, t.postal, keep=["row_id"])
    want = Counter(tuple(r) for r in plain.drop("row_id").collect())
    want[tuple(plain.filter("row_id = 7").drop("row_id").first())] += times
    assert Counter(tuple(r) for r in pairs.collect()) == want


def test_scores_are_taken_from_stored_rows(spark):
    """Lowest and highest sum and the rows themselves do not go back to the tender file."""
    t = Tables(spark, FOLDER)
    assert "customer.parquet" not in plan_of(bids.bid_zone_pairs(t.bid, t.country_table, t.postal, keep=["row_id"]))
