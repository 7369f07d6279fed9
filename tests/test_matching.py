"""Searching tries, choosing columns, correcting zones, dates of a whole column."""

import itertools
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from lanewise.operators import bids, clean, edit_search, facets, matching
from test_edges import brute_force
from test_plans import plan_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def by_word(text):
    return " ".join(sorted(text.split(" ")))


def score(a, b):
    longest, nearest = max(len(a), len(b)), min(distance(a, b), distance(by_word(a), by_word(b)))
    short, long = sorted((a, b), key=len)
    begins = short and long.startswith(short) and 3 * len(short) <= 2 * len(long) and len(long) <= 8 * len(short)
    return max(((longest - nearest) * 200 + longest) // (2 * longest) if longest else 0, 90 if begins else 0)


@pytest.mark.parametrize("cells", [1, 60, 1 << 21])
def test_tries_equal_brute_force(monkeypatch, cells):
    monkeypatch.setattr(edit_search, "CELLS", cells)
    rng = random.Random(cells)

    def text():
        return " ".join("".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 4)))

    for _ in range(80):
        entries = list({text() for _ in range(rng.randint(1, 14))})
        ords = rng.sample(range(99), len(entries))
        texts = sorted({text() for _ in range(10)})
        known = edit_search.Entries([(e, by_word(e), o) for e, o in zip(entries, ords)])
        want = [min((100 - score(t, e)) * edit_search.ORD_SPACE + o for e, o in zip(entries, ords)) for t in texts]
        assert known.best([(t, by_word(t)) for t in texts]) == want


def test_near_texts_meet_few_entries(monkeypatch):
    """Of 20,000 entries, texts with one wrong digit touch less than one in a hundred."""
    extended = 0
    original = edit_search.Trie.search

    def counted(self, texts, most, best):
        nonlocal extended
        monkeypatch.setattr(edit_search, "closeness", lambda d, n, f=closeness: tally(d, n, f))
        original(self, texts, most, best)

    def tally(d, n, f):
        nonlocal extended
        extended += getattr(d, "size", 1)
        return f(d, n)

    closeness = edit_search.closeness
    monkeypatch.setattr(edit_search.Trie, "search", counted)
    known = edit_search.Entries([(f"fr {i:05d}", f"{i:05d} fr", i) for i in range(0, 100_000, 5)])
    texts = [(f"fr {i:05d}"[:6] + "x" + f"{i:05d}"[4], "") for i in range(0, 1000, 5)]
    ranks = known.best([(t, by_word(t)) for t, _ in texts])
    assert all(100 - (r >> 48) >= 75 for r in ranks) and extended < len(texts) * 200


def test_long_cells_find_their_entry(spark):
    """Thousands of edits are not too many."""
    rng = random.Random(8)
    start = "".join(rng.choices("abcdefgh", k=4_000))
    long = start + "".join(rng.choices("ij", k=9_000))
    choices = spark.createDataFrame([("X", start + "k" * 900, 3), ("X", "zz", 1), ("X", "yy", 2)], "block string, text string, ord long")
    keys = spark.createDataFrame([("X", long), ("X", "zy"), (None, "a"), ("Y", "a")], "block string, text string")
    got = {(r.block, r.text): (r.score, r.ord) for r in matching.best_match(keys, choices).collect()}
    # 4,900 characters of the entry and 13,000 of the text: 9,000 edits.
    assert got == {("X", long): (31, 3), ("X", "zy"): (50, 1), (None, "a"): (None, None), ("Y", "a"): (None, None)}


def test_lists_in_parts_and_texts_in_pieces(spark):
    rng = random.Random(6)
    entries = [(rng.choice("XXXY"), " ".join(rng.choices(["ab", "abc", "b", "cab", "éa"], k=3)), i) for i in range(120)]
    choices = spark.createDataFrame(entries, "block string, text string, ord long")
    texts = {(rng.choice("XXXY"), "".join(rng.choices("abcé ", k=rng.randint(0, 9)))) for _ in range(150)}
    keys = spark.createDataFrame(sorted(texts), "block string, text string")
    found = matching.best_match(keys, choices, work=200, most_entries=10)
    assert {(r.block, r.text): (r.score, r.ord) for r in found.collect()} == brute_force(keys, choices)


def test_a_list_is_sent_at_most_once_per_task_and_piece(spark):
    choices = spark.range(300).selectExpr("'FR' AS block", "format_string('FR %05d', id) AS text", "id AS ord")
    keys = spark.range(5000).selectExpr("'FR' AS block", "format_string('FR %05d', id * 7) AS text")
    sizes = []
    original, matching.stored = matching.stored, lambda df, name: sizes.append((name, original(df, name))) or sizes[-1][1]
    try:
        plan = plan_of(matching.best_match(keys, choices, work=1))
    finally:
        matching.stored = original
    pieces = dict(sizes)["pieces"].first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pieces.pieces <= matching.PIECES_PER_TASK * tasks and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_all_blocks_share_the_pieces(spark):
    """Each piece gets the whole list of its block, so many blocks must not get as many pieces each as one would."""
    number = F.expr("format_string('%05d', id)")
    entries = spark.range(6000).select((F.col("id") % 20).cast("string").alias("block"), number.alias("text"), F.col("id").alias("ord"))
    keys = spark.range(6000).select((F.col("id") % 20).cast("string").alias("block"), F.substring(number, 2, 4).alias("text")).distinct()
    sizes = []
    original, matching.stored = matching.stored, lambda df, name: sizes.append((name, original(df, name))) or sizes[-1][1]
    try:
        matching.best_match(keys, entries, work=1)
    finally:
        matching.stored = original
    pieces = [r.pieces for r in dict(sizes)["pieces"].collect()]
    cores = spark.sparkContext.defaultParallelism
    assert len(pieces) == 20 and sum(pieces) <= matching.PIECES_PER_TASK * cores + 20


def test_without_edits_left_only_the_next_character_is_tried(monkeypatch):
    """Texts that lack a digit, in a list of all numbers: not all ten children of a node are compared."""
    tried, original = 0, edit_search.Trie.step

    def counted(self, *args):
        nonlocal tried
        parent, child = original(self, *args)
        tried += len(child)
        return parent, child

    monkeypatch.setattr(edit_search.Trie, "step", counted)
    known = edit_search.Entries([(f"{i:05d}", f"{i:05d}", i) for i in range(100_000)])
    texts = sorted({f"{i:05d}"[:2] + f"{i:05d}"[3:] for i in range(0, 100_000, 997)})
    lowest = [min(int(t[:at] + str(d) + t[at:]) for d in range(10) for at in range(5)) for t in texts]
    assert known.best([(t, t) for t in texts]) == [20 * edit_search.ORD_SPACE + i for i in lowest]
    assert tried < len(texts) * 250


def test_column_assignment_equals_trying_all(spark):
    rng = random.Random(4)
    for _ in range(6):
        rows = [
            (f"c{i}", i, rng.choice([0.0, 0.2, 0.5, 0.9]), rng.choice([0.0, 0.3, 0.5, 0.8]), rng.random() < 0.6, rng.random() < 0.5)
            for i in range(rng.randint(0, 5))
        ]
        fields = "column string, position int, country_share double, zip_share double, names_origin boolean, names_destination boolean"
        found = {r.role: (r.column, r.share) for r in bids.column_assignment(spark.createDataFrame(rows, fields)).collect()}

        def share(role, row):
            origin, kind = role.startswith("origin"), 2 if role.endswith("cntry") else 3
            return row[kind] if row[4 if origin else 5] and not row[5 if origin else 4] else 0.0

        best = 0.0
        for chosen in itertools.product([None, *rows], repeat=4):
            named = [r for r in chosen if r]
            if len({r[0] for r in named}) == len(named) and all(r is None or share(role, r) > 0 for role, r in zip(bids.ROLES, chosen)):
                best = max(best, sum(share(role, r) for role, r in zip(bids.ROLES, chosen) if r))
        assert sum(s for _, s in found.values()) == pytest.approx(best)
        assert len({c for c, _ in found.values()}) == len(found)
        by_name = {r[0]: r for r in rows}
        assert all(share(role, by_name[c]) == s > 0 for role, (c, s) in found.items())


def test_corrections(spark):
    pairs = spark.createDataFrame(
        [(1, "A", None, True), (2, None, None, True), (3, "C", "D", True), (None, "E", "F", False)],
        "row_id long, origin_zc string, destination_zc string, needs_review boolean",
    )
    given = [(1, "destination", "Z"), (1, "destination", "Y"), (2, "origin", "X"), (3, "origin", None), (3, "both", "Q"), (9, "origin", "W"), (None, "origin", "V")]
    corrections = spark.createDataFrame(given, "row_id long, end string, zc string")
    found = {r.row_id: (r.origin_zc, r.destination_zc, r.needs_review, r.review_flag, r.corrected) for r in bids.apply_corrections(pairs, corrections, ["row_id"]).collect()}
    assert found == {
        1: ("A", "Y", False, "non", True),
        2: ("X", None, True, "oui", True),
        3: ("C", "D", True, "oui", False),
        None: ("V", "F", False, "non", True),
    }


@pytest.mark.parametrize(
    ("texts", "third"),
    [
        (["03/04/2024", "15/04/2024"], date(2024, 4, 3)),
        (["03/04/2024", "04/15/2024"], date(2024, 3, 4)),
        (["03/04/2024", None, "soon"], date(2024, 3, 4)),
        (["03/04/2024", "15/04/2024", "04/15/2024"], date(2024, 3, 4)),
        (["03/04/2024", "15/04/2024", "16/04/2024", "04/15/2024"], date(2024, 4, 3)),
        (["03/04/2024", "15.04.2024"], date(2024, 3, 4)),
    ],
)
def test_dates_are_read_in_the_order_of_their_column(spark, texts, third):
    rows = spark.createDataFrame([(t, 1.0, 1.0, 1.0) for t in texts], "ship_date string, kg double, ldm double, m3 double")
    found = [r.ship_date for r in clean.coerce_types(rows).collect()]
    assert found[0] == third
    assert all((f is None) == (t in (None, "soon")) for f, t in zip(found, texts))
    alone = [r.ship_date for r in clean.coerce_types(rows, by_column=False).collect()]
    assert alone[0] == date(2024, 3, 4)


@pytest.mark.parametrize("list_bytes", [1 << 24, 0])
def test_longest_zone_equals_brute_force(spark, list_bytes):
    rng = random.Random(list_bytes)
    zones = {"".join(rng.choices("AB1", k=rng.randint(1, 6))) for _ in range(300)} | {"", "é", "éa"}
    texts = {"".join(rng.choices("AB12é", k=rng.randint(0, 10))) for _ in range(500)} | {"", "C", "éab"}
    postal = spark.createDataFrame([("X", z, z, i) for i, z in enumerate([*zones, None])], "country string, full_zc string, zc string, ord bigint")
    keys = spark.createDataFrame([("X", t) for t in texts], "country string, text string")
    got = {r.text: r.prefix for r in bids.longest_start(keys, postal, list_bytes).collect()}
    assert got == {t: max((t[:k] for k in range(len(t) + 1) if t[:k] in zones), key=len, default=None) for t in texts}
    assert bids.longest_start(keys, postal.limit(0), list_bytes).filter("prefix is null").count() == len(texts)


def test_search_of_zones_moves_no_texts(spark, tmp_path):
    postal = spark.createDataFrame([("X", "A1", "A", 1), ("X", "B1", "B", 2)], "country string, full_zc string, zc string, ord bigint")
    spark.createDataFrame([("X", "A12")], "country string, text string").write.parquet(f"{tmp_path}/texts")
    keys = spark.read.parquet(f"{tmp_path}/texts")
    lines = plan_of(bids.longest_start(keys, postal)).splitlines()
    # Subqueries hang on lines with a colon before the name of the operator.
    texts = "\n".join(line for line in lines if ":" not in re.match("[^A-Za-z]*", line).group())
    assert "Scan" in texts and not any(name in texts for name in ("Exchange", "Generate", "Join"))
    # The list stays a subquery's value; no row carries it.
    assert "sorted_zones" not in texts


def test_facet_options_equal_plain_rules(spark):
    rng = random.Random(7)
    names = ["branch", "cntry_from", "zc_from", "cntry_to", "zc_to", "product", "way"]
    rows = [tuple(rng.choice(["a", "b", "c", None]) for _ in names) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    for chosen in ({}, {"branch": ["a"], "cntry_to": ["b", "c"]}, {"cntry_from": ["c"], "zc_from": ["a"]}):
        want = set()
        for row in rows:
            for number, (name, value) in enumerate(zip(names, row)):
                want.add((number, name, value))
                if name in facets.NARROWING and chosen.get(name) and value not in chosen[name]:
                    break
        assert {tuple(r) for r in facets.facet_options(df, chosen).collect()} == want
