"""Exact duplicates by comparing recipes of content-defined chunks.

A text without its white space is cut where its own characters say so (a pair
of characters that is repeated at once), so equal texts have equal chunks. Of
each chunk only a short identifier (64 bits) and a digest travel, about a
thirtieth of the text. The chunk table holds every identifier once per digest;
an identifier that stands for two different chunks is found there, and texts
with such a chunk are compared by their ordered digests instead. All others
are equal exactly when their ordered identifier lists are.

Everything is DataFrame expressions. Groups are combined before each shuffle;
the hot key of a large group of copies meets one row in a join that adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.storage import stored

SPACES = " \t\n\x0b\x0c\r"
SHORTEST, LONGEST = 512, 4096


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text as an array of chunks that joined give the text again.

    A chunk ends at the first pair of characters that occurs twice in a row
    after ``shortest`` characters, and after ``longest`` at the latest.
    """
    ends = rf"(?s).{{{shortest},{longest}}}?(.)(.)\1\2|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(ends), F.lit(0))


def identifier(chunk: Column, bits: int) -> Column:
    value = F.xxhash64(chunk)
    return value if bits == 64 else F.shiftrightunsigned(value, 64 - bits)


def recipes(docs: DataFrame, key: str, text: str, bits: int = 64) -> DataFrame:
    """One row per document: ``row``, ``id``, ``points``, ``raw_hash``, ``text_sha256``, ``ids`` and ``digests``."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{key}`").alias("id"),
        F.length(whole).cast("bigint").alias("points"),
        F.xxhash64(whole).alias("raw_hash"),
        F.translate(whole, SPACES, "").alias("bare"),
    )
    cut = bare.withColumn("chunks", chunks(F.col("bare")))
    return cut.select(
        "row",
        "id",
        "points",
        "raw_hash",
        F.sha2("bare", 256).alias("text_sha256"),
        F.transform("chunks", lambda c: identifier(c, bits)).alias("ids"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def ambiguous(found: DataFrame) -> DataFrame:
    """Identifiers in the chunk table that stand for more than one digest."""
    pieces = found.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests")
    table = pieces.groupBy("ids", "digests").agg(F.count("*").alias("n"))
    return table.groupBy("ids").agg(F.count("*").alias("n")).where("n > 1").select("ids")


def verified(found: DataFrame) -> DataFrame:
    """Recipes with ``extra``: the digests of a text that has an ambiguous identifier, else empty."""
    clash = stored(ambiguous(found), "ambiguous")
    if clash.isEmpty():
        return found.withColumn("extra", F.array().cast("array<binary>"))
    touched = found.select("row", F.explode("ids").alias("ids")).join(clash, "ids", "left_semi").select("row").distinct()
    marked = found.join(touched.withColumn("touched", F.lit(True)), "row", "left")
    none = F.array().cast("array<binary>")
    return marked.withColumn("extra", F.when(F.col("touched"), F.col("digests")).otherwise(none)).drop("touched")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: its key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``
    and ``raw_hash`` of the text as it is.

    Texts are equal if they are identical without the characters ``SPACES``;
    null counts as empty. The row with the most code points stays, then the
    smallest key; a null key comes last. Of rows that repeat in all this, one
    stays. Other columns are left out, whatever their names. The recipes are
    written to the shared folder first. ``bits`` shortens the identifiers, for
    tests of the verification.
    """
    found = verified(stored(recipes(docs, key, text, bits), "recipes"))
    best = F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")
    groups = found.groupBy("ids", "extra").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
    several = groups.where("group_size > 1")
    joined = found.join(several, ["ids", "extra"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        "raw_hash",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS bare
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM t
"""
