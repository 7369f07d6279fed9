from datetime import date

import pytest
from pyspark.sql import functions as F

from lanewise.functions.text import comparable, similarity, sorted_tokens
from lanewise.operators import bids, clean, collection, enrich, facets, matching, regions, regularity, summary

COLUMNS = "zc_from string, zc_to string, ship_date string, kg string, ldm string, m3 string, branch string"


def test_text_in_a_measure_keeps_the_row(spark):
    raw = spark.createDataFrame([("FR 01", "GB 02", "2024-01-01", "abc", "2", None, None)], COLUMNS)
    row = enrich.enrich_shipments(clean.clean_shipments(raw)).first()
    assert (row.kg, row.ldm, row.m3, row.branch) == (None, 2.0, 0.0, "undefined")
    assert (row.pay_weight, row.bracket, row["product"], row.zc_to) == (None, 25500, "FTL", "UK 02")


@pytest.mark.parametrize("bad", ["12d", "12f", "12 kg", "Infinity", "-Infinity", "1e400", " ", "NaN", "0x1F", "1.2.3"])
def test_what_is_no_number_is_null(spark, bad):
    raw = spark.createDataFrame([("FR 01", "DE 02", None, bad, "2", " 7e1 ", "b")], COLUMNS)
    row = clean.coerce_types(raw).first()
    assert (row.kg, row.ldm, row.m3) == (None, 2.0, 70.0)
    ships = summary.summary_rows(enrich.enrich_shipments(clean.clean_shipments(raw)))
    assert summary.product_matrix(ships).count() == 4


def test_infinite_measures_do_not_end_a_job(spark):
    rows = [("FR 01", "DE 02", None, x, 1.0, 1.0, "b") for x in (float("inf"), float("-inf"), float("nan"), 1e300, 5.0)]
    raw = spark.createDataFrame(rows, "zc_from string, zc_to string, ship_date date, kg double, ldm double, m3 double, branch string")
    ships = summary.summary_rows(enrich.enrich_shipments(clean.clean_shipments(raw)))
    assert [r.kg for r in ships.orderBy("kg").collect()] == [0.0, 5.0]
    assert summary.way_product(ships).first().total == 2


@pytest.mark.parametrize(
    "text, expected",
    [("2024-03-05", (3, 5)), ("15/01/2024", (1, 15)), ("03/05/2024", (3, 5)), ("5.3.2024", (3, 5)), ("05-03-2024", (3, 5)),
     (" 2024-03-05 ", (3, 5)), ("31.02.2024", None), ("soon", None), ("", None)],
)
def test_dates_as_text(spark, text, expected):
    raw = spark.createDataFrame([("FR 01", "DE 02", text, "1", "2", "3", "b")], COLUMNS)
    day = clean.coerce_types(raw).first().ship_date
    assert (day and (day.month, day.day)) == expected
    own = clean.coerce_types(raw, ["dd/MM/yyyy"]).first().ship_date
    assert own == (date(2024, 5, 3) if text == "03/05/2024" else day)


def test_roles_of_ambiguous_headers(spark):
    headers = ["Shipping to country", "Shipping to zip", "Zone pays de depart", "zip depart", "from/to zip", "OriginCountry"]
    rows = [("France", "75008", "Spain", "28001", "1234", "Frnce"), ("Italy", "00100", "France", "69001", "1", "x")]
    bid = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in headers))
    iso = spark.createDataFrame([(0, "FR", "France"), (1, "ES", "Spain"), (2, "IT", "Italy")], "ord int, iso2 string, country_1 string")
    roles = {r.role: r.column for r in bids.column_roles(bids.column_profile(bid, bids.country_names(iso))).collect()}
    assert roles == {
        "destination_cntry": "Shipping to country", "destination_zipcode": "Shipping to zip",
        "origin_cntry": "Zone pays de depart", "origin_zipcode": "zip depart",
    }
    only = bid.select("Shipping to country", "Shipping to zip")
    found = bids.column_roles(bids.column_profile(only, bids.country_names(iso)))
    assert {r.role for r in found.collect()} == {"destination_cntry", "destination_zipcode"}
    assert not bids.bid_feasible(found).first().has_both_ends


def test_a_misspelt_country_column_still_fills_its_role(spark):
    rows = [("Frnce",), ("Spian",), ("Itlay",), ("Germny",), ("France",)]
    bid = spark.createDataFrame(rows, "`Origin country` string")
    iso = spark.createDataFrame([(0, "FR", "France")], "ord int, iso2 string, country_1 string")
    roles = bids.column_roles(bids.column_profile(bid, bids.country_names(iso))).collect()
    assert [(r.role, r.column, r.share) for r in roles] == [("origin_cntry", "Origin country", 0.2)]


def test_ord_out_of_range_ends_the_job(spark):
    keys = spark.createDataFrame([("X", "a")], "block string, text string")
    for wrong in (-1, 1 << 48, None):
        choices = spark.createDataFrame([("X", "b", wrong)], "block string, text string, ord long")
        with pytest.raises(Exception, match="ord is out of range"):
            matching.best_match(keys, choices).collect()


def test_centroid_of_an_outline_without_area(spark):
    rows = [("A", 0, 0, i, x, x) for i, x in enumerate((0.0, 2.0, 4.0, 0.0))]
    vertices = spark.createDataFrame(rows, "region_id string, part int, ring int, seq int, lon double, lat double")
    got = regions.region_centroid(vertices).first()
    assert (got.lon, got.lat) == pytest.approx((1.5, 1.5)) or (got.lon, got.lat) == pytest.approx((2.0, 2.0))


def test_rows_are_kept_or_rejected(spark):
    rows = [
        ("FR 01", "DE 02", None, "1", None, None, "b"),
        (None, "DE 02", None, "1", None, None, "b"),
        ("FR 01", "DE 02", "bad", "0", None, "NaN", "b"),
        ("RU 12", "AD 1", "bad", "-5", "0", "0", "b"),
    ]
    raw = spark.createDataFrame(rows, COLUMNS)
    kept = enrich.enrich_shipments(clean.clean_shipments(raw)).orderBy("zc_from").collect()
    assert clean.rejected_rows(raw).count() == 2 and len(kept) == 2
    assert (kept[1].zc_from, kept[1].zc_to, kept[1].ship_date) == ("RU", "AD", None)
    assert (kept[1].bracket, kept[1]["product"]) == (250, "Parcel")


def test_dates_apply_only_when_complete(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2025, 1, 1),)], "ship_date date")
    period = (date(2024, 1, 1), date(2024, 6, 1))
    assert facets.date_range_filter(df, period).count() == 1
    gap = df.unionAll(spark.createDataFrame([(None,)], "ship_date date"))
    assert facets.date_range_filter(gap, period).count() == 3


@pytest.mark.parametrize(
    "cell, expected", [(" 12.0", "12.0"), ("12.0", "12"), (".5", ""), ("1.2.3", "1.2.3"), (None, "")]
)
def test_cells(spark, cell, expected):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(bids.normalise_cell(F.col("c")).alias("c")).first().c == expected


def test_zip_bands_and_buckets(spark):
    df = spark.createDataFrame([("SW1A-2 a", "GB"), ("F-75 008", "FR")], "z string, c string")
    assert [r[0] for r in df.select(bids.clean_zip(F.col("z"), F.col("c"))).collect()] == ["SW1A2a", "75008"]
    shares = spark.createDataFrame([(8, 100), (100, 100), (9, 100), (7, 100)], "n int, t int")
    bands = [r[0] for r in shares.select(regularity.share_band(F.col("n"), F.col("t"))).collect()]
    assert bands == [None, "=100", ">8", "<8"]
    metres = spark.sql("select explode(array(10.0, 10.01, 13.6, 13.61)) as m")
    assert [r[0] for r in metres.select(collection.ldm_bucket(F.col("m"))).collect()] == [10, 11, 11, 12]


def test_single_region_and_equal_scores(spark):
    one = spark.createDataFrame([("FR", 3.0)], "region_id string, value double")
    assert regions.marker_radius(one).first().radius == 10.0
    equal = spark.createDataFrame([(50, 50), (50, 50)], "origin_score long, destination_score long")
    assert {(r.match_score, r.needs_review) for r in bids.match_score(equal).collect()} == {(1.0, False)}


def test_centroid_with_a_hole(spark):
    outer = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(2.0, 1.0), (3.0, 1.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0)]
    rows = [("A", 0, ring, i, x, y) for ring, pts in enumerate((outer, hole)) for i, (x, y) in enumerate(pts)]
    vertices = spark.createDataFrame(rows, "region_id string, part int, ring int, seq int, lon double, lat double")
    got = regions.region_centroid(vertices).first()
    assert got.lon == pytest.approx((16 * 2 - 2 * 2.5) / 14) and got.lat == pytest.approx(2.0)


def test_best_match_equals_brute_force(spark):
    entries = [("FR", f"FR {n:05d}") for n in range(0, 99999, 617)] + [("FR", "FR 75"), ("GB", "GB SW1A 2AA")]
    entries += [("FR", "a very long reference name with many words")]
    choices = spark.createDataFrame([(b, t, i) for i, (b, t) in enumerate(entries)], "block string, text string, ord long")
    texts = ["FR 75", "FR 7", "FR 00617", "FR 0617", "FR 99", "FR 123456789", "617 FR", "---", "x", "FR 00617000",
             "a very long name with many reference words", "zzzzzzzzzzzzzzzzzzzzzzzzz", "FR 1234"]
    keys = [("FR", t) for t in texts] + [("GB", "GB SW1A2AA"), ("GB", "FR 75"), ("XK", "XK 1")]
    keys = spark.createDataFrame(keys, "block string, text string")
    got = {(r.block, r.text): (r.score, r.ord) for r in matching.best_match(keys, choices).collect()}
    assert got == {**brute_force(keys, choices), ("XK", "XK 1"): (None, None)}


def brute_force(keys, choices):
    """Every text with every entry of its block: the best score, then the lowest ord."""
    k, c = comparable(F.col("text")), comparable(F.col("c"))
    scored = keys.join(choices.withColumnRenamed("text", "c"), "block").withColumn(
        "score", similarity(k, sorted_tokens(k), c, sorted_tokens(c))
    )
    best = scored.groupBy("block", "text").agg(F.min(F.struct(-F.col("score"), "ord")).alias("best"))
    return {(r.block, r.text): (-r.best[0], r.best[1]) for r in best.collect()}


def test_best_match_of_random_texts(spark):
    import random

    rng = random.Random(7)

    def text():
        words = ["".join(rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 5, 9)))) for _ in range(rng.choice((1, 1, 2, 3, 5)))]
        return rng.choice((" ", " ", "-")).join(words)

    entries = [(b, t, i) for i, (b, t) in enumerate((rng.choice("XXY"), text()) for _ in range(250))]
    choices = spark.createDataFrame(entries, "block string, text string, ord long")
    texts = {(rng.choice("XXY"), text()) for _ in range(400)} | {("X", ""), ("X", "--"), ("Y", "zz top")}
    keys = spark.createDataFrame(sorted(texts), "block string, text string")
    got = {(r.block, r.text): (r.score, r.ord) for r in matching.best_match(keys, choices).collect()}
    assert got == brute_force(keys, choices)


def test_one_block_holds_most_texts(spark):
    choices = spark.range(500).select(F.lit("FR").alias("block"), F.format_string("FR %05d", F.col("id") * 199).alias("text"), F.col("id").alias("ord"))
    keys = spark.range(400).select(F.lit("FR").alias("block"), F.format_string("FR %05d", F.col("id") * 233).alias("text"))
    one, many = (matching.best_match(keys, choices, work=n).orderBy("text").collect() for n in (10**9, 3_000))
    assert one == many and len(one) == 400 and all(r.score is not None for r in one)


def test_legacy_score_leaves_out_the_destination_country(spark):
    df = spark.createDataFrame([(50, 50, 100, 0), (50, 50, 0, 100)], "origin_score int, destination_score int, origin_country_score int, destination_country_score int")
    assert {r.match_score for r in bids.match_score(df).collect()} == {1.0}
    assert {r.match_score for r in bids.match_score(df, legacy_score=True).collect()} == {0.1, 1.0}


def test_facets_need_both_categories(spark):
    df = spark.createDataFrame([("b", "x", None)], "branch string, category1 string, category2 string")
    assert facets.facets_of(df)[:3] == ["branch", "category1", "category2"]
    assert "category1" not in facets.facets_of(df.drop("category2"))
    assert facets.facet_filter(df, facets=["branch", "category1", "category2"]).count() == 0
    assert facets.facet_filter(df, {"branch": ["b"]}, facets=["branch", "category1"]).count() == 1
