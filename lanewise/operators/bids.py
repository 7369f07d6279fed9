"""Cleaning of a tender file into zone pairs: cells, column roles, countries, zones, scores."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.numbers import half_up_ratio, total
from lanewise.functions.text import comparable, strip
from lanewise.operators.matching import best_match, checked_ord
from lanewise.storage import stored

ROLES = ("origin_cntry", "origin_zipcode", "destination_cntry", "destination_zipcode")
SIDES = ("origin", "destination")
MATCHED = ("cntry", "zipcode", "iso2", "country_score", "zone", "match", "score", "zc")

# Header words that tell the two ends of a shipment apart.
ORIGIN_WORDS = ("origin", "collection", "depart", "chargement", "from", "shipping", "consignor")
DESTINATION_WORDS = ("destination", "arrivée", "to", "livraison", "consignee", "delivery")
# Of these, the one that only counts where no other word names an end: goods are shipped to somewhere, too.
LOOSE_WORDS = ("shipping",)
# A name is numbered by its column and the place of its row, in so much room per column.
NAME_SPACE = 1 << 40

# Countries whose postal codes contain letters.
LETTER_ZIP_COUNTRIES = ("GB", "IE")

# Length of a full postal code by country.
ZIP_LENGTHS = {
    "AL": 4, "AT": 4, "BA": 5, "BE": 4, "BG": 4, "CH": 4, "CZ": 5,
    "DE": 5, "DK": 4, "EE": 5, "ES": 5, "FI": 5, "FR": 5, "GR": 5,
    "HR": 5, "HU": 4, "IT": 5, "LT": 5, "LU": 4, "LV": 5, "ME": 5,
    "MK": 4, "NL": 4, "NO": 4, "PL": 5, "PT": 7, "RO": 6, "RS": 5,
    "SE": 5, "SI": 4, "SK": 5, "TR": 5, "XK": 5,
}


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def normalise_cell(cell: Column) -> Column:
    """Text without outer blanks; a plain number loses what follows its point."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    number = F.rlike(text, F.lit(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"))
    return strip(F.when(number, F.substring_index(text, ".", 1)).otherwise(text))


def normalise_bid(bid: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Normalise every cell and drop rows in which all are empty.

    Columns in ``keep`` (row keys, for instance) are passed on untouched and do
    not count.
    """
    cells = [c for c in bid.columns if c not in keep]
    cleaned = bid.select(*[_quoted(c) for c in keep], *[normalise_cell(_quoted(c)).alias(c) for c in cells])
    filled = F.lit(False)
    for c in cells:
        filled = filled | (_quoted(c) != "")
    return cleaned.filter(filled)


def bid_head_csv(bid: DataFrame, order: str, rows: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """Header and first rows as CSV lines, for a look at the columns."""
    cells = [c for c in bid.columns if c not in keep]
    head = bid.orderBy(_quoted(order)).limit(rows)
    lines = head.select(F.to_csv(F.struct(*[_quoted(c) for c in cells]), {"emptyValue": ""}).alias("line"))
    header = bid.sparkSession.range(1).select(F.lit(",".join(cells)).alias("line"))
    return header.unionAll(lines)


def country_names(iso: DataFrame, order: str = "ord") -> DataFrame:
    """The wide list of country names as one row per name.

    Names are taken column by column; a name that occurs again belongs to its
    first country. ``ord`` numbers the names in that order, with gaps.
    """
    wide = [c for c in iso.columns if c.startswith("country_")]
    place = {name: number for number, name in enumerate(wide)}
    if len(wide) > 256:
        raise ValueError(f"{len(wide)} columns of names; there is room for 256")
    long = iso.unpivot([order, "iso2"], wide, "variable", "country").filter(F.col("country").isNotNull())
    number = F.lit(0).cast("bigint")
    for name, position in place.items():
        number = F.when(F.col("variable") == name, F.lit(position).cast("bigint")).otherwise(number)
    ranked = long.withColumn("place", number * NAME_SPACE + checked_ord(F.col(order), NAME_SPACE))
    return ranked.groupBy("country").agg(F.min_by("iso2", "place").alias("iso2"), F.min("place").alias("ord"))


def fuzzy_country(texts: DataFrame, names: DataFrame, min_score: int | None = None) -> DataFrame:
    """Best country for each different, filled ``text``.

    ``names`` is the result of :func:`country_names`.
    """
    keys = texts.select("text").filter("text is not null and text <> ''").distinct()
    everywhere = names.select(F.lit("").alias("block"), F.col("country").alias("text"), "ord")
    best = best_match(keys.withColumn("block", F.lit("")), everywhere).drop("block")
    named = best.join(names.select("ord", "country", "iso2"), "ord", "left")
    if min_score is not None:
        named = named.filter(F.col("score") >= min_score)
    return named.select("text", F.col("country").alias("matched"), "score", "iso2")


def clean_zip(zipcode: Column, country: Column) -> Column:
    """Letters and digits for countries with lettered codes, digits elsewhere."""
    lettered = F.regexp_replace(zipcode, "[^A-Za-z0-9]", "")
    digits = F.regexp_replace(zipcode, "[^0-9]", "")
    return F.when(country.isin(*LETTER_ZIP_COUNTRIES), lettered).otherwise(digits)


def compose_zone(iso: Column, zipcode: Column) -> Column:
    """``ISO zip``, null when either is missing or empty."""
    return F.when((iso != "") & (zipcode != ""), F.concat_ws(" ", iso, zipcode))


def short_zone(iso: Column, zipcode: Column) -> Column:
    """``ISO`` and the first two characters of the postal code."""
    return compose_zone(iso, F.substring(zipcode, 1, 2))


def pad_zip(country: Column, zipcode: Column) -> Column:
    """Leading zeros up to the country's length; codes of two characters stay."""
    length = F.lit(None).cast("int")
    for code, digits in ZIP_LENGTHS.items():
        length = F.when(country == code, F.lit(digits)).otherwise(length)
    fits = (F.length(zipcode) == 2) | length.isNull() | (F.length(zipcode) >= length)
    return F.when(fits, zipcode).otherwise(F.lpad(zipcode, length, F.lit("0")))


def fuzzy_zone(zones: DataFrame, postal: DataFrame) -> DataFrame:
    """Best entry of the postal reference for each different zone, within its country.

    ``zones`` has ``country`` and ``text``; ``postal`` has ``country``,
    ``full_zc``, ``zc`` and ``ord``.
    """
    keys = zones.filter("country is not null and text is not null").select("country", "text").distinct()
    choices = postal.select("country", F.col("full_zc").alias("text"), "ord")
    best = best_match(keys, choices, block="country")
    entries = postal.select("country", "ord", "full_zc", "zc")
    return best.join(entries, ["country", "ord"], "left").select("country", "text", "full_zc", "score", "zc")


# Bytes of a reference list that tasks may hold as one array; a larger list is joined.
LIST_BYTES = 16 << 20


def _beginnings(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """Each ``text`` with the zones (``prefix``) it starts with, a row per pair, by a join on its beginnings."""
    lengths = listed.agg(F.collect_set(F.length("prefix"))).scalar()
    fitting = F.filter("lengths", lambda n: n <= F.length("text"))
    pieces = F.transform(fitting, lambda n: F.substring(F.col("text"), F.lit(1), n))
    exploded = texts.withColumn("lengths", lengths).withColumn("prefix", F.explode(pieces)).drop("lengths")
    return exploded.join(listed, "prefix")


def _with_searched_start(keys: DataFrame, zones: Column, number: int) -> DataFrame:
    """``prefix``: the longest of ``number`` sorted zones that ``text`` starts with.

    All zones with which the text begins are beginnings of the last zone that
    does not come after the text, which is found by halving the steps. Each
    column of zones is used once, so that none is made: the search refers to
    the list itself.
    """
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(number.bit_length()))))
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get("sorted_zones", at + step - 1)["zone"] <= F.col("text"), at + step).otherwise(at),
    )
    starts = F.get("sorted_zones", F.col("place") - 1)["starts"]
    placed = keys.withColumn("sorted_zones", zones).select(*keys.columns, place.alias("place"))
    chosen = placed.withColumn("sorted_zones", zones).select(*keys.columns, starts.alias("starts"))
    longest = F.get(F.filter("starts", lambda start: F.startswith(F.col("text"), start)), F.lit(0))
    return chosen.select(*keys.columns, longest.alias("prefix"))


def longest_start(keys: DataFrame, postal: DataFrame, list_bytes: int = LIST_BYTES) -> DataFrame:
    """``keys`` (``country``, ``text``) with the longest reference zone each text starts with as ``prefix``, or null.

    Every task searches the sorted list, so texts do not move. A list of more
    than ``list_bytes`` is joined with the beginnings of the texts instead.
    """
    listed = postal.filter("zc is not null").select(F.col("zc").alias("prefix")).distinct()
    nested = _beginnings(listed.select(F.col("prefix").alias("text")), listed)
    starts = nested.groupBy(F.col("text").alias("zone")).agg(F.sort_array(F.collect_list("prefix"), asc=False).alias("starts"))
    starts = stored(starts, "zones")
    size = F.sum(F.octet_length("zone") * (1 + F.size("starts")) + 32)
    number, held = starts.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    if held <= list_bytes:
        zones = starts.agg(F.sort_array(F.collect_list(F.struct("zone", "starts")))).scalar()
        return _with_searched_start(keys, zones, number)
    found = _beginnings(keys, listed).groupBy("country", "text").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return keys.join(found, ["country", "text"], "left")


def prefix_zone(zones: DataFrame, postal: DataFrame, list_bytes: int = LIST_BYTES) -> DataFrame:
    """Longest reference zone each text starts with, else the best fuzzy match."""
    keys = zones.filter("country is not null and text is not null").select("country", "text").distinct()
    started = stored(longest_start(keys, postal, list_bytes), "starts")
    found = started.filter("prefix is not null").select(
        "country", "text", F.col("prefix").alias("zc"), F.lit(100).cast("bigint").alias("score")
    )
    rest = fuzzy_zone(started.filter("prefix is null"), postal)
    return found.unionByName(rest.select("country", "text", "zc", "score"))


def match_score(bid: DataFrame, legacy_score: bool = False) -> DataFrame:
    """Score of a row from 0.1 to 1 and whether somebody should look at it.

    The sum of the four scores is scaled between the lowest and the highest sum
    of the table; with equal sums every row gets 1, or 0.1 if there are no
    scores. A row with an end that has no reference zone is always for review.
    ``legacy_score`` leaves out the score of the destination country, as older
    reports did.
    """
    parts = ["origin_score", "destination_score", "origin_country_score", "destination_country_score"]
    if legacy_score:
        parts.remove("destination_country_score")
    points = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts if p in bid.columns), F.lit(0)).cast("bigint")
    ends = bid.agg(F.struct(F.min(points).alias("low"), F.max(points).alias("high"))).scalar()
    spread = bid.withColumn("ends", ends)
    low, high = F.col("ends.low"), F.col("ends.high")
    # 0.1 + 0.9 * x in hundredths, as a ratio of whole numbers.
    scaled = half_up_ratio(F.lit(10) * (high - low) + F.lit(90) * (points - low), (high - low) * 100, 2)
    score = F.when(high > low, scaled).otherwise(F.when(high > 0, F.lit(1.0)).otherwise(F.lit(0.1)))
    review = score <= 0.9
    for side in SIDES:
        if f"{side}_zc" in bid.columns:
            review = review | F.col(f"{side}_zc").isNull()
    return spread.withColumns(
        {"match_score": score, "needs_review": review, "review_flag": F.when(review, "oui").otherwise("non")}
    ).drop("ends")


def header_words(column: Column) -> Column:
    """The words of a header in lower case; a capital after a small letter starts a word."""
    return F.split(comparable(F.regexp_replace(column, r"(\p{Ll})(\p{Lu})", "$1 $2")), " ")


def column_profile(bid: DataFrame, names: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """How much each column looks like a country or postal code of either end.

    ``names`` is the result of :func:`country_names`. Shares are per thousand of
    the filled cells. ``position`` is the column's place in the file.
    """
    cells = [c for c in bid.columns if c not in keep]
    long = bid.select(*[_quoted(c) for c in cells]).unpivot([], [_quoted(c) for c in cells], "column", "cell")
    # Different cells meet the names once, with their number.
    counted = long.filter("cell <> ''").groupBy("column", "cell").agg(F.count(F.lit(1)).alias("times"))
    filled = counted.withColumn("name", comparable(F.col("cell")))
    spelt = names.select(comparable(F.col("country")).alias("name"))
    codes = names.select(comparable(F.col("iso2")).alias("name"))
    known = stored(spelt.unionByName(codes).distinct().withColumn("known", F.lit(1)), "known")
    looks_like_zip = F.rlike("cell", F.lit("^[A-Za-z0-9][A-Za-z0-9 -]+$")) & F.rlike("cell", F.lit("[0-9]"))
    shares = (
        filled.join(known, "name", "left")
        .groupBy("column")
        .agg(
            F.sum("times").alias("cells"),
            total(F.when(F.col("known") == 1, F.col("times"))).alias("country_cells"),
            total(F.when(looks_like_zip, F.col("times"))).alias("zip_cells"),
        )
    )
    words = header_words(F.col("column"))

    def among(listed: Sequence[str]) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))

    clear = [w for w in ORIGIN_WORDS if w not in LOOSE_WORDS]
    to = among(DESTINATION_WORDS)
    return shares.select(
        "column",
        (F.array_position(F.array(*[F.lit(c) for c in cells]), F.col("column")) - 1).alias("position"),
        "cells",
        half_up_ratio(F.col("country_cells"), F.col("cells"), 3).alias("country_share"),
        half_up_ratio(F.col("zip_cells"), F.col("cells"), 3).alias("zip_share"),
        (among(clear) | (among(LOOSE_WORDS) & ~to)).alias("names_origin"),
        to.alias("names_destination"),
    )


def column_roles(profile: DataFrame) -> DataFrame:
    """The column that fills each role, and the share of its cells that look like it.

    Header words name the end; a header that names both ends fills no role. Of
    a column, the kind that more cells look like counts, so it fills one role at
    most. Of several columns the one with the largest share is taken, then the
    first in the file. A role is left open only if no column's header names its
    end and has a cell of its kind.
    """
    candidates = []
    for side, opposite in (SIDES, SIDES[::-1]):
        for kind, suffix in (("country", "cntry"), ("zip", "zipcode")):
            other = "zip" if kind == "country" else "country"
            share = F.col(f"{kind}_share")
            fits = F.col(f"names_{side}") & ~F.col(f"names_{opposite}") & (share > F.col(f"{other}_share"))
            role = F.struct(F.lit(f"{side}_{suffix}").alias("role"), "column", "position", share.alias("share"))
            candidates.append(F.when(fits, role))
    listed = profile.select(F.inline(F.array_compact(F.array(*candidates))))
    best = F.min(F.struct((-F.col("share")).alias("order"), "position", "column", "share"))
    return listed.groupBy("role").agg(best.alias("best")).select("role", "best.column", "best.share")


def _paired_with(zipcodes: Column) -> Callable[[Column], Column]:
    """The pairs of a country's column with all columns of postal codes but itself; either may be null."""
    last = F.lit(2**31 - 1)

    def pair(country: Column, zipcode: Column) -> Column:
        shares = F.coalesce(country["order"], F.lit(0.0)) + F.coalesce(zipcode["order"], F.lit(0.0))
        places = [F.coalesce(c["position"], last).alias(name) for c, name in ((country, "first"), (zipcode, "second"))]
        return F.struct(shares.cast("decimal(10,3)").alias("order"), *places, country.alias("c"), zipcode.alias("z"))

    def pairs(country: Column) -> Column:
        free = F.filter(zipcodes, lambda z: ~F.coalesce(z["column"] == country["column"], F.lit(False)))
        return F.transform(free, lambda z: pair(country, z))

    return pairs


def column_assignment(profile: DataFrame) -> DataFrame:
    """The columns that fill the roles best together, and the share of their cells that look like it.

    Of all ways to give each role a column or none, and no column two roles, the
    one with the largest sum of shares; of equal ones, that whose columns come
    first in the file. Header words name the end; a header that names both ends
    fills no role, nor does a column without a cell of the kind.

    Only a country and a postal code of the same end can want the same column,
    so the best two columns of each are enough to find the best pair.
    """
    columns = []
    for side, opposite in (SIDES, SIDES[::-1]):
        for kind, suffix in (("country", "cntry"), ("zip", "zipcode")):
            share = F.col(f"{kind}_share")
            fits = F.col(f"names_{side}") & ~F.col(f"names_{opposite}") & (share > 0)
            found = F.when(fits, F.struct((-share).alias("order"), "position", "column"))
            columns.append(F.slice(F.array_sort(F.collect_list(found)), 1, 2).alias(f"{side}_{suffix}"))
    best_two = profile.agg(*columns)
    nothing = F.lit(None).cast("struct<order:double,position:int,column:string>")
    roles = []
    for side in SIDES:
        country, zipcode = (F.array_append(F.col(f"{side}_{suffix}"), nothing) for suffix in ("cntry", "zipcode"))

        best = F.array_min(F.flatten(F.transform(country, _paired_with(zipcode))))
        for suffix, part in (("cntry", "c"), ("zipcode", "z")):
            chosen = best[part]
            role = F.struct(F.lit(f"{side}_{suffix}").alias("role"), chosen["column"].alias("column"), (-chosen["order"]).alias("share"))
            roles.append(F.when(chosen.isNotNull(), role))
    return best_two.select(F.inline(F.array_compact(F.array(*roles))))


def bid_feasible(roles: DataFrame) -> DataFrame:
    """Whether any country and postal code was found, and whether both ends were."""

    def found(*wanted: str) -> Column:
        tests = [F.coalesce(F.max(F.col("role") == role), F.lit(False)) for role in wanted]
        combined = tests[0]
        for test in tests[1:]:
            combined = combined & test
        return combined

    country = F.coalesce(F.max(F.endswith("role", F.lit("_cntry"))), F.lit(False))
    zipcode = F.coalesce(F.max(F.endswith("role", F.lit("_zipcode"))), F.lit(False))
    return roles.agg((country & zipcode).alias("has_country_and_zip"), found(*ROLES).alias("has_both_ends"))


def apply_roles(
    bid: DataFrame,
    roles: DataFrame | Mapping[str, str],
    keep: Sequence[str] = (),
    given: Mapping[str, str] | None = None,
) -> DataFrame:
    """Only the four role columns (and ``keep``), under their role names.

    ``roles`` is a mapping from role to column, or the result of
    :func:`column_roles`; the latter is looked up when the query runs, so
    nothing is fetched beforehand. The roles in ``given`` override it one by
    one. A role without a column becomes null.
    """
    given = given or {}
    if isinstance(roles, Mapping):
        chosen = [_quoted(roles[r]).alias(r) if r in roles else F.lit(None).cast("string").alias(r) for r in ROLES]
        return bid.select(*[_quoted(c) for c in keep], *chosen)
    cells = [c for c in bid.columns if c not in keep]
    picked = roles.agg(
        F.struct(*[F.max(F.when(F.col("role") == r, F.col("column"))).alias(r) for r in ROLES])
    ).scalar()
    with_roles = bid.withColumn("_roles", picked)

    def cell_of(role: str) -> Column:
        if role in given:
            return _quoted(given[role])
        return F.coalesce(*[F.when(F.col(f"_roles.{role}") == c, _quoted(c)) for c in cells])

    return with_roles.select(*[_quoted(c) for c in keep], *[cell_of(r).alias(r) for r in ROLES])


def different_ends(bid: DataFrame) -> DataFrame:
    """Each different country and postal code of either end, stored; one pass over the rows."""
    either = [F.struct(F.col(f"{s}_cntry").alias("cntry"), F.col(f"{s}_zipcode").alias("zipcode")) for s in SIDES]
    return stored(bid.select(F.inline(F.array(*either))).distinct(), "ends")


def _coded(ends: DataFrame, names: DataFrame) -> DataFrame:
    countries = stored(fuzzy_country(ends.select(F.col("cntry").alias("text")), names), "countries")
    found = countries.select(F.col("text").alias("cntry"), F.col("score").alias("country_score"), "iso2")
    coded = ends.join(found, "cntry", "left")
    return coded.withColumn("zone", compose_zone(F.col("iso2"), clean_zip(F.col("zipcode"), F.col("iso2"))))


def coded_ends(bid: DataFrame, names: DataFrame) -> DataFrame:
    """Each different country and postal code of either end, with country code and zone.

    Everything after the pass over the rows works on different pairs only. The
    pairs and the matches are stored, because both are used more than once.
    """
    return _coded(different_ends(bid), names)


def _matched(ends: DataFrame, names: DataFrame, postal: DataFrame) -> DataFrame:
    coded = _coded(ends, names)
    zones = stored(fuzzy_zone(coded.select(F.col("iso2").alias("country"), F.col("zone").alias("text")), postal), "zones")
    found = zones.select(
        F.col("country").alias("iso2"), F.col("text").alias("zone"), F.col("full_zc").alias("match"), "score", "zc"
    )
    return coded.join(found, ["iso2", "zone"], "left").select(*MATCHED)


def matched_ends(bid: DataFrame, names: DataFrame, postal: DataFrame) -> DataFrame:
    """The different ends of a tender file with their country and reference zone."""
    return _matched(different_ends(bid), names, postal)


def _fingerprint(*tables: DataFrame) -> str:
    """A name for reference lists; lists with other rows, or with another ``ord``, have another one."""
    marks = []
    for table in tables:
        row = F.xxhash64(F.to_json(F.struct(*[_quoted(c) for c in sorted(table.columns)])))
        sums = table.select(row.alias("row")).agg(F.count("row"), F.sum(F.col("row").cast("decimal(20,0)")))
        marks.append("_".join(map(str, sums.first())))
    return hashlib.sha256(" ".join(marks).encode()).hexdigest()


def known_ends(bid: DataFrame, names: DataFrame, postal: DataFrame, dictionary: str) -> DataFrame:
    """``matched_ends`` of a tender file, and of all files before it that met the same reference lists.

    ``dictionary`` is a folder that all executors share; below it, what has been
    matched is kept by a fingerprint of the reference lists. Only ends that it
    does not hold are matched and added. Two files at the same time may both add
    an end; the rows are equal and count once.
    """
    spark, ends = bid.sparkSession, different_ends(bid)
    path = f"{dictionary.rstrip('/')}/{_fingerprint(names, postal)}"
    try:
        before = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        before = None
    new = ends
    if before is not None:
        met = [ends[c].eqNullSafe(before[c]) for c in ("cntry", "zipcode")]
        new = stored(ends.join(before, met, "left_anti"), "new-ends")
    if before is None or not new.isEmpty():
        _matched(new, names, postal).write.mode("append").parquet(path)
    return spark.read.parquet(path).dropDuplicates(["cntry", "zipcode"])


def bid_zone_pairs(
    bid: DataFrame,
    iso: DataFrame,
    postal: DataFrame,
    roles: Mapping[str, str] | None = None,
    keep: Sequence[str] = (),
    legacy_score: bool = False,
    dictionary: str | None = None,
) -> DataFrame:
    """A messy tender file as clean zone pairs with a score per row.

    ``roles`` overrides the found column of single roles. An end whose country
    or postal code has no column cannot be built: its columns are null, and all
    rows are for review. ``dictionary`` is a folder in which matches are kept
    for the next file (see ``known_ends``). Tables are written while the result
    is being built.
    """
    cells = normalise_bid(bid, keep)
    names = country_names(iso)
    if roles is not None and set(ROLES) <= set(roles):
        df = apply_roles(cells, roles, keep)
    else:
        # The roles are stored, or every later pass over the rows would profile all cells again.
        df = apply_roles(cells, stored(column_assignment(column_profile(cells, names, keep)), "roles"), keep, roles)
    if dictionary:
        ends = stored(known_ends(df, names, postal, dictionary), "matched")
    else:
        ends = stored(matched_ends(df, names, postal), "matched")
    # Written once: the lowest and highest sum and the rows read the same lookups.
    return match_score(stored(_with_ends(df, ends), "scored"), legacy_score)


def _with_ends(df: DataFrame, ends: DataFrame) -> DataFrame:
    for side in SIDES:
        lookup = ends.select(
            F.col("cntry").alias(f"{side}_cntry"),
            F.col("zipcode").alias(f"{side}_zipcode"),
            F.col("iso2").alias(f"iso_{side}"),
            F.col("country_score").alias(f"{side}_country_score"),
            F.col("zone").alias(f"{side}_zone"),
            F.col("match").alias(f"{side}_match"),
            F.col("score").alias(f"{side}_score"),
            F.col("zc").alias(f"{side}_zc"),
        )
        met = [df[f"{side}_{part}"].eqNullSafe(lookup[f"{side}_{part}"]) for part in ("cntry", "zipcode")]
        df = df.join(lookup, met, "left").drop(*[lookup[f"{side}_{part}"] for part in ("cntry", "zipcode")])
    return df


def apply_corrections(pairs: DataFrame, corrections: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Zone pairs after somebody has looked at them.

    ``corrections`` has the row keys ``keep``, ``end`` ("origin" or "destination")
    and the right ``zc``. A corrected zone replaces the found one. A row with a
    correction has been looked at: it is for review only as long as an end has
    no zone. Of several corrections of one end the smallest zone counts; those
    without a zone, of unknown ends or of rows that are not there do nothing.
    Null keys meet null keys.
    """
    given = corrections.where(F.col("zc").isNotNull() & F.col("end").isin(*SIDES))
    one = given.groupBy(*keep).agg(*[F.min(F.when(F.col("end") == side, F.col("zc"))).alias(f"_{side}") for side in SIDES])
    met = [pairs[k].eqNullSafe(one[k]) for k in keep]
    joined = pairs.join(one, met, "left").drop(*[one[k] for k in keep])
    seen = F.col("_origin").isNotNull() | F.col("_destination").isNotNull()
    zones = {f"{side}_zc": F.coalesce(f"_{side}", f"{side}_zc") for side in SIDES}
    missing = zones["origin_zc"].isNull() | zones["destination_zc"].isNull()
    review = F.when(seen, missing).otherwise(F.col("needs_review"))
    flag = F.when(review, "oui").otherwise("non")
    columns = {**zones, "needs_review": review, "review_flag": flag, "corrected": seen}
    return joined.withColumns(columns).drop("_origin", "_destination")
