"""How the sources of a language differ in their terms, over the terms that are frequent in the language.

Frequent terms are found as iceberg cells by prefix refinement. A level counts,
per language, the documents that hold a term beginning with each prefix of so
many bytes, and of complete terms up to that length. Prefixes below the
threshold are discarded: no term that begins with them can reach it. The next
level extends only what is left, until every kept prefix is a complete term.
Lengths double from level to level, so levels grow with the logarithm of the
longest kept term.

A level is one pass over the texts. A task adds up its own prefixes before they
are shuffled, in a table of bounded size. The kept prefixes reach the tasks as a
filter of ``FILTER_BITS`` bits whatever their number; a prefix that passes it by
chance is discarded by its own count, so the filter never changes a result.

The distance of two sources is a sum over all kept terms. Terms go to blocks,
sources to tiles, and a task adds up one pair of tiles over one block in arrays;
no row is made per term and pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.workers import hand_back, importable, slices
from lanewise.storage import stored

FIRST_LEVEL = 4  # bytes
FILTER_BITS = 1 << 24
BITMAP_BITS = 1 << 15  # fixed value: of one of Spark's bitmaps
HELD = 1_500_000  # prefixes by source that a task holds at once
SLICE = 4 << 20  # bytes of text whose words are held at once
LEAST_DOCS = 30
TOP_TERMS = 50
TERM_BLOCK = 4096
SOURCE_TILE = 128
SCALE, PRIOR = 1_000_000_000, 5
#: Small letters and what is beyond ASCII stay, capitals become small, all else is a border.
FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
LEVEL = "lang string, source string, prefix binary, complete boolean, docs long, times long"
COLUMNS = ["lang", "source", "prefix", "complete", "docs", "times"]


def hashed(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))


def filter_places(langs: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """Bits of the filter, from hashes of languages and of prefixes."""
    return ((langs ^ prefixes) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def words_of(texts: list[bytes], parent: int = 0) -> tuple[pa.Array, pa.Array]:
    """All words of some texts that are longer than ``parent``, and the number of each word's text."""
    folded = pa.array([t.translate(FOLDED) for t in texts], pa.binary())
    # Seen as strings, whatever their bytes, as only those can be split.
    split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(folded), *folded.buffers()[1:]))
    words, owners = split.flatten().cast(pa.binary()), pc.list_parent_indices(split)
    longer = pc.greater(pc.binary_length(words), parent)
    return words.filter(longer), owners.filter(longer)


class Partial:
    """Documents and occurrences by (language, source, prefix, complete) of the texts of one task."""

    KEYS = ["group", "prefix", "complete"]

    def __init__(self, length: int, parent: int, bits: np.ndarray | None):
        self.length, self.parent, self.bits = length, parent, bits
        self.groups: dict[tuple[str, str], int] = {}
        self.cells: list[pa.Table] = []
        self.size, self.full = 0, False

    def extended(self, words: pa.Array, langs: np.ndarray) -> pa.Array:
        """Whether the beginning of a word that is longer than the level before may have been kept there."""
        before = pc.binary_slice(words, 0, self.parent).dictionary_encode()
        places = filter_places(langs, hashed(before.dictionary.to_pylist())[before.indices.to_numpy()])
        return pa.array((self.bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool))

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        groups = np.array([self.groups.setdefault(pair, len(self.groups)) for pair in zip(langs, sources)], np.int64)
        words, owners = words_of(texts, self.parent)
        if self.parent:
            found = hashed([lang.encode("utf-8", "replace") for lang in langs])
            kept = self.extended(words, found[owners.to_numpy()])
            words, owners = words.filter(kept), owners.filter(kept)
        complete = pc.less_equal(pc.binary_length(words), self.length)
        table = pa.table({"owner": owners, "prefix": pc.binary_slice(words, 0, self.length), "complete": complete})
        once = table.group_by(["owner", "prefix", "complete"], use_threads=False).aggregate([([], "count_all")])
        columns = {"group": groups[once["owner"].to_numpy()], "prefix": once["prefix"], "complete": once["complete"]}
        met = pa.table({**columns, "times": once["count_all"]}).group_by(self.KEYS, use_threads=False)
        self.take(met.aggregate([([], "count_all"), ("times", "sum")]).rename_columns([*self.KEYS, "docs", "times"]))

    def take(self, cells: pa.Table) -> None:
        self.cells.append(cells)
        self.size += cells.num_rows
        if self.size > HELD:  # many of which are equal
            met = pa.concat_tables(self.cells).group_by(self.KEYS, use_threads=False).aggregate([("docs", "sum"), ("times", "sum")])
            self.cells = [met.rename_columns([*self.KEYS, "docs", "times"])]
            self.size, self.full = met.num_rows, 2 * met.num_rows > HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.cells:
            return
        self.size = HELD + 1
        self.take(self.cells.pop())
        langs, sources = (pa.array([pair[i] for pair in self.groups], pa.string()) for i in (0, 1))
        for batch in self.cells.pop().to_batches(max_chunksize=1 << 16):
            group, *others = batch.columns
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), *others], COLUMNS)
        self.size, self.full = 0, False


def _level(texts: DataFrame, length: int, parent: int, bits: bytes | None) -> DataFrame:
    """Cells of one level by source; all cells of a prefix are in one task."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        partial = Partial(length, parent, None if held is None else np.frombuffer(held, np.uint8))
        for batch in batches:
            langs, sources = batch["lang"].to_pylist(), batch["source"].to_pylist()
            first = 0
            for part in slices(batch["text"], SLICE):
                end = first + len(part)
                partial.add(langs[first:end], sources[first:end], part)
                if partial.full:
                    yield from partial.rows()
                first = end
        yield from partial.rows()
        hand_back()

    cells = texts.mapInArrow(count, LEVEL).repartition("lang", "prefix")
    return cells.groupBy("lang", "source", "prefix", "complete").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))


def _filter(prefixes: DataFrame) -> bytes:
    """The kept (lang, prefix) as a bit field; at most ``FILTER_BITS`` bits come to the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = hashed([lang.encode("utf-8", "replace") for lang in batch["lang"].to_pylist()])
            places = filter_places(langs, hashed(batch["prefix"].to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(places)], ["place"])

    rows = prefixes.select("lang", "prefix").mapInArrow(places, "place long")
    bucket, bit = F.floor(F.col("place") / BITMAP_BITS).cast("int"), (F.col("place") % BITMAP_BITS).cast("bigint")
    maps = rows.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect()
    field = bytearray(FILTER_BITS // 8)
    for at, bits in maps:
        field[at * BITMAP_BITS // 8 : at * BITMAP_BITS // 8 + len(bits)] = bits
    return bytes(field)


def kept_terms(texts: DataFrame, least: int = LEAST_DOCS, first: int = FIRST_LEVEL) -> DataFrame:
    """(lang, source, term, times) of the terms that lie in ``least`` documents of their language, where they occur.

    ``texts`` has ``lang`` and ``source`` without nulls and ``text`` as bytes.
    """
    complete, length, parent, bits = [], first, 0, None
    while True:
        cells = stored(_level(texts, length, parent, bits), "cells")
        frequent = cells.groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least)
        complete.append(cells.where("complete").join(frequent.where("complete").drop("in_docs", "complete"), ["lang", "prefix"]))
        open_prefixes = stored(frequent.where("NOT complete").select("lang", "prefix"), "prefixes")
        if open_prefixes.isEmpty():
            break
        bits, parent, length = _filter(open_prefixes), length, length * 2
    found = complete[0]
    for level in complete[1:]:
        found = found.unionByName(level)
    return found.select("lang", "source", F.col("prefix").cast("string").alias("term"), "times")


def share(times: Column | str, n: Column | str, terms: Column | str) -> Column:
    """The smoothed share of a term, in whole billionths and never 0; null if there are no terms."""
    times, n, terms = (F.col(c) if isinstance(c, str) else c for c in (times, n, terms))
    wide = "decimal(20,0)"
    part = F.lit(SCALE).cast("decimal(10,0)") * (times.cast(wide) + PRIOR)
    return F.when(terms > 0, 1 + F.call_function("div", part, n.cast(wide) + F.lit(PRIOR).cast("decimal(1,0)") * terms.cast(wide)))


def _tile_sums(group: pa.Table) -> pa.Table:
    """Sums over the terms of a block for one pair of tiles: how much further apart two sources are than without the terms.

    Rows without a term say what a source's share of a term is that it lacks.
    """
    sources, side = group["number"].to_numpy(), group["side"].to_numpy()
    share_, absent = group["p"].to_numpy(), group["absent"].to_numpy()
    names, row = np.unique(sources, return_inverse=True)
    base = np.zeros(len(names), np.int64)
    base[row] = absent
    with_term = group["term"].is_valid().to_numpy(zero_copy_only=False)
    column = np.zeros(len(row), np.int64)
    words, column[with_term] = np.unique(np.array(group["term"].filter(group["term"].is_valid()).to_pylist(), object), return_inverse=True)
    values = np.repeat(base[:, None], len(words), axis=1)
    values[row[with_term], column[with_term]] = share_[with_term]
    sides = [np.unique(row[side == s]) for s in (0, 1)]
    one_tile = not len(sides[1])
    rest = sides[0] if one_tile else sides[1]
    first, second, sums = [], [], []
    for a in sides[0]:
        others = rest[rest != a]
        further = np.abs(values[others] - values[a]).sum(axis=1) - len(words) * np.abs(base[others] - base[a])
        for x, y in ((a, others), (others, a)) if not one_tile else ((a, others),):
            first.append(np.broadcast_to(names[x], len(others)))
            second.append(np.broadcast_to(names[y], len(others)))
            sums.append(further)
    lang = [group["lang"][0].as_py()] * sum(map(len, sums))
    parts = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (first, second, sums)]
    return pa.table({"lang": pa.array(lang, pa.string()), "number": parts[0], "other": parts[1], "further": parts[2]})


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each source to each other one of its language."""
    ordered = Window.partitionBy("lang").orderBy("source")
    numbered = stored(groups.withColumn("number", F.row_number().over(ordered).cast("bigint") - 1), "groups")
    tiles = numbered.groupBy("lang").agg((F.floor(F.max("number") / SOURCE_TILE) + 1).cast("bigint").alias("tiles"), F.max("terms").alias("terms"))
    tile = F.floor(F.col("number") / SOURCE_TILE).cast("bigint")
    blocks = F.greatest(F.ceil(F.col("terms") / TERM_BLOCK), F.lit(1)).cast("bigint")

    def to_pairs(rows: DataFrame) -> DataFrame:
        """A tile meets every tile: rows of the smaller number are side 0. Of one tile with itself there is only side 0."""
        others = rows.join(tiles.select("lang", "tiles"), "lang").withColumn("tile", tile)
        spread = others.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
        side = (F.col("tile") > F.col("with")).cast("int")
        return spread.withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with"), "side": side})

    columns = ["lang", "low", "high", "block", "side", "number", "term", "p", "absent"]
    own = shares.join(numbered.select("lang", "source", "number"), ["lang", "source"])
    found = to_pairs(own.withColumn("block", F.pmod(F.xxhash64("term"), blocks))).select(*columns)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    marks = numbered.where("terms > 0").withColumns({"block": every, "term": F.lit(None).cast("string"), "p": F.col("absent")})
    rows = found.unionByName(to_pairs(marks).select(*columns))
    kind = "lang string, number long, other long, further long"
    sums = rows.groupBy("lang", "low", "high", "block").applyInArrow(_tile_sums, kind)
    total = sums.groupBy("lang", "number", "other").agg(F.sum("further").alias("further"))
    a = numbered.select("lang", "source", "number", "terms", "absent")
    b = numbered.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("absent").alias("other_absent"))
    # One row per pair of sources is the result itself.
    both = a.join(b, "lang").where("number != other").join(total, ["lang", "number", "other"], "left")
    apart = F.col("terms") * F.abs(F.col("absent") - F.col("other_absent")) + F.coalesce("further", F.lit(0))
    return both.select("lang", "source", "item", F.coalesce(apart, F.lit(0)).cast("bigint").alias("value"))


def divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every pair of language and source that occurs.

    Part ``pair``: each other source of the language and the sum of the
    differences of all kept terms' shares. Part ``term``: the ``top`` terms whose
    share in the source exceeds that in the language most. Ranks go by value,
    then by item. Nulls count as empty: an empty language or source is one of
    its own, an empty text has no terms. Every row is a document, repeated ones
    too. A language without kept terms has distances 0 and no terms; an empty
    table gives no rows. Other columns are left out, whatever their names.
    Levels are stored while the result is being built.
    """
    importable(docs.sparkSession)
    whole = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]
    texts = docs.select(*whole, F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    times = stored(kept_terms(texts, least), "terms")
    in_lang = times.groupBy("lang", "term").agg(F.sum("times").alias("lang_times"))
    of_lang = in_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_times").alias("lang_n"))
    of_group = times.groupBy("lang", "source").agg(F.sum("times").alias("n"))
    every = texts.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = every.select(
        "lang",
        "source",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "terms", "lang_n")],
    )
    groups = stored(groups.withColumn("absent", share(F.lit(0), "n", "terms")), "groups")
    shares = times.join(groups, ["lang", "source"]).withColumn("p", share("times", "n", "terms"))
    pairs = _pairs(shares.select("lang", "source", "term", "p", "terms", "absent"), groups).withColumn("part", F.lit("pair"))
    q = share("lang_times", "lang_n", "terms")
    above = shares.join(in_lang, ["lang", "term"]).withColumn("value", F.col("p") - q).where("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    best = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(best.select(*columns))


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS terms
  FROM documents
),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM lt GROUP BY lang),
g AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY ALL
),
p AS (
  SELECT g.lang, g.source, lt.term, coalesce(c.n, 0) AS times,
         1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR}) // (g.n + {PRIOR} * l.v) AS p,
         1 + {SCALE}::HUGEINT * (lt.n + {PRIOR}) // (l.n + {PRIOR} * l.v) AS q
  FROM g JOIN lt USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = lt.term
),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE times > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
