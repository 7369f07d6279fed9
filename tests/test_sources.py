import json

import pytest
from pyspark.sql import functions as F

from lanewise.operators import answers, bids
from lanewise.schema import POSTAL_HEADERS
from lanewise.sources import files, sinks


def square(x, y, size):
    return [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]


FEATURES = [
    {"type": "Feature", "properties": {"NUTS_ID": "FR1", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 4), square(1, 1, 1)]}},
    {"type": "Feature", "properties": {"NUTS_ID": "FR2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 0, 1)], [square(5, 5, 1)]]}},
    {"type": "Feature", "properties": {"NUTS_ID": "FR1"}, "geometry": {"type": "Polygon", "coordinates": [square(9, 9, 1)]}},
]


def test_geojson_document_and_lines(spark, tmp_path):
    document, lines = tmp_path / "regions.geojson", tmp_path / "regions.jsonl"
    document.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    lines.write_text("\n".join(json.dumps(f) for f in FEATURES))
    read = [
        files.region_vertices(files.read_features(spark, str(p), as_lines), "NUTS_ID")
        .orderBy("region_id", "part", "ring", "seq")
        .collect()
        for p, as_lines in ((document, False), (lines, True))
    ]
    assert read[0] == read[1] and len(read[0]) == 20
    assert {(r.region_id, r.part, r.ring) for r in read[0]} == {("FR1", 0, 0), ("FR1", 0, 1), ("FR2", 0, 0), ("FR2", 1, 0)}
    assert max(r.lon for r in read[0] if r.region_id == "FR1") == 4.0


def test_shipments_with_their_own_headers(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("ZC from,ZC to,kg,ldm,m3,Branch,Category1,note\nFR 01,DE 02,12,,1.5,Lyon,a,x\n")
    df = files.read_shipments(spark, str(path), "csv")
    assert df.columns == ["zc_from", "zc_to", "ship_date", "kg", "ldm", "m3", "branch"]
    assert df.first().ship_date is None


def test_tender_file_is_text_with_trimmed_headers(spark, tmp_path):
    path = tmp_path / "bid.csv"
    path.write_text(" Origin country ,Zip \nFrance,012.0\n,\n")
    df = files.read_bid(spark, str(path))
    assert df.columns == ["Origin country", "Zip"] and {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in bids.normalise_bid(df).collect()] == [("France", "012")]


def test_lists_in_many_files_keep_their_order(spark, tmp_path):
    """Spark reads large files first; a list goes by the names of its files all the same."""
    postal, regions = tmp_path / "postal", tmp_path / "regions"
    postal.mkdir()
    regions.mkdir()
    header, zones = ",".join(POSTAL_HEADERS), [[f"Z{part}{row:05d}" for row in range(10 ** (part + 1))] for part in range(4)]
    for part, listed in enumerate(zones):
        (postal / f"part-{part}.csv").write_text("\n".join([header, *[",".join([z] * len(POSTAL_HEADERS)) for z in listed], ""]))
        again = {"type": "Feature", "properties": {"NUTS_ID": "FR1", "name": "x" * 10**part, "part": part}}
        (regions / f"part-{part}.json").write_text(json.dumps(again) + "\n")
    block = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (block, "64KB"):  # of which the last file has several
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = files.read_postal(spark, str(postal))
            got = [r.full_zc for r in sorted(read.collect(), key=lambda r: r.ord)]
            assert got == [z for listed in zones for z in listed] and read.schema["ord"].dataType.simpleString() == "bigint"
            features = files.read_features(spark, str(regions), lines=True)
            assert files.region_attributes(features, 0, "NUTS_ID", "part").first().name == "0"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)


def test_round_trip_of_tables(spark, tmp_path):
    df = spark.range(10).withColumn("text", F.lit("a,b"))
    paths = sinks.write_tables({"one": df, "two": df.filter("id > 4")}, str(tmp_path / "out"), "csv")
    assert files.read_table(spark, paths["one"], "csv").count() == 10
    assert files.read_table(spark, paths["two"], "csv").filter("text = 'a,b'").count() == 5


def test_a_failed_export_is_not_seen(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(10)
    wrong = df.select(F.raise_error(F.lit("no third sheet")).cast("string").alias("text"))
    assert files.read_tables(spark, path) == {}
    with pytest.raises(Exception, match="no third sheet"):
        sinks.write_tables({"one": df, "two": df, "three": wrong}, path)
    assert files.read_tables(spark, path) == {}
    sinks.write_tables({"one": df, "two": df.filter("id > 4")}, path)
    first = files.read_tables(spark, path)
    assert {name: t.count() for name, t in first.items()} == {"one": 10, "two": 5}
    with pytest.raises(ValueError, match="already"):
        sinks.write_tables({"one": df}, path)
    with pytest.raises(Exception, match="no third sheet"):
        sinks.write_tables({"one": df.filter("id > 8"), "three": wrong}, path, mode="overwrite")
    assert files.read_tables(spark, path)["one"].count() == 10
    sinks.write_tables({"one": df.filter("id > 8")}, path, "csv", "overwrite")
    assert {name: t.count() for name, t in files.read_tables(spark, path).items()} == {"one": 1}
    assert first["two"].count() == 5


def test_a_second_file_matches_new_ends_only(spark, tmp_path, monkeypatch):
    iso = spark.createDataFrame([(0, "FR", "France"), (1, "DE", "Germany")], "ord int, iso2 string, country_1 string")
    zones = [(0, "FR", "FR 75008", "FR 75"), (1, "FR", "FR 69001", "FR 69"), (2, "DE", "DE 80331", "DE 80")]
    postal = spark.createDataFrame(zones, "ord int, country string, full_zc string, zc string")
    rows = [("1", "France", "75008", "Germny", "80331"), ("2", "Frnce", "69002", None, None)]
    shape = "id string, " + ", ".join(f"{role} string" for role in bids.ROLES)
    roles, matched, asked = {role: role for role in bids.ROLES}, bids._matched, []

    def counting(ends, names, postal):
        asked.append(ends.count())
        return matched(ends, names, postal)

    monkeypatch.setattr(bids, "_matched", counting)

    def pairs(rows, postal, dictionary=None):
        done = bids.bid_zone_pairs(spark.createDataFrame(rows, shape), iso, postal, roles, ["id"], dictionary=dictionary)
        return done.orderBy("id").collect()

    plain, known = pairs(rows, postal), str(tmp_path / "known")
    assert pairs(rows, postal, known) == plain
    assert pairs(rows, postal, known) == plain
    more = [*rows, ("3", "Deutschland", "80331", "France", "75008")]
    assert pairs(more, postal, known) == pairs(more, postal)
    other = postal.where("ord > 0")
    assert pairs(rows, other, known) == pairs(rows, other)
    # Without a dictionary all ends are matched, with it new ones, and all where a list has changed.
    assert asked == [4, 4, 1, 5, 4, 4]


def test_roles_by_mapping_and_by_contents(spark):
    bid = spark.createDataFrame(
        [("1", "France", "75008", "x"), ("2", "fr", "69001", "y")],
        "id string, `Country from` string, `Zip from` string, `City to` string",
    )
    iso = spark.createDataFrame([(0, "FR", "France")], "ord int, iso2 string, country_1 string")
    roles = bids.column_roles(bids.column_profile(bid, bids.country_names(iso), keep=["id"]))
    assert {tuple(r) for r in roles.collect()} == {("origin_cntry", "Country from", 1.0), ("origin_zipcode", "Zip from", 1.0)}
    feasible = bids.bid_feasible(roles).first()
    assert (feasible.has_country_and_zip, feasible.has_both_ends) == (True, False)
    found = bids.apply_roles(bid, roles, keep=["id"]).orderBy("id").collect()
    mapped = bids.apply_roles(bid, {"origin_cntry": "Country from", "origin_zipcode": "Zip from"}, keep=["id"])
    assert found == mapped.orderBy("id").collect()
    assert found[0].origin_zipcode == "75008" and found[0].destination_cntry is None


def test_answer_tables(spark):
    text = "-A: b: c: d\n-no\n-Q: r\n-F: 1: 2\n-Go: yes"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    first = answers.answer_lines(df, "id", lines=3).orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in first] == [("A", "b", "c: d"), ("Q", "r", "")]
    assert [tuple(r)[2:] for r in answers.fuel_lines(df, "id", after=3).collect()] == [("F", "1: 2")]
    assert tuple(answers.verdict_line(df, "id").first()) == (1, "Go", "yes", "")
    chunks = answers.token_chunks(spark.createDataFrame([(1, " a b\nc "), (2, " ")], "id int, text string"), "id", size=2)
    assert [tuple(r) for r in chunks.collect()] == [(1, 0, 2, "a b"), (1, 1, 1, "c")]
