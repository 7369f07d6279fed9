"""Best fuzzy match of many texts against a reference list, without pairing all with all.

The result is exactly the best-scoring reference entry for every text (ties go
to the lower ``ord``). Work is done once per different comparable text. A task
gets a part of a block's texts and the block's entries, which it searches as
tries (see ``edit_search``); no row per pair is ever produced.

A block is dealt out by its share of all comparisons, so one block may hold
most of the texts, but all blocks together into no more pieces than keep the
cores busy or a task's texts few: the list is sent and its tries are built once
per piece, not once per so many comparisons.
A long list is cut into parts, and the best of the parts counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.text import comparable, sorted_tokens
from lanewise.operators.edit_search import ORD_SPACE, Entries
from lanewise.storage import stored
from lanewise.workers import importable

# Comparisons that are worth a piece of their own, pieces per core in all blocks, and texts and entries that a task gets at once.
WORK = 50_000
PIECES_PER_TASK = 4
MOST_TEXTS = 100_000
MOST_ENTRIES = 100_000


def checked_ord(ord_: Column, space: int = ORD_SPACE) -> Column:
    """``ord`` as a number from 0 to below ``space``; anything else ends the job."""
    whole = ord_.cast("bigint")
    wrong = F.raise_error(F.concat(F.lit("ord is out of range: "), F.coalesce(whole.cast("string"), F.lit("null"))))
    return F.when((whole >= 0) & (whole < space), whole).otherwise(wrong.cast("bigint"))


def _choices(choices: DataFrame, block: str) -> DataFrame:
    """One row per block and comparable text: the first entry of equal texts."""
    listed = choices.select(F.col(block).alias("block"), comparable(F.col("text")).alias("c_text"), checked_ord(F.col("ord")).alias("ord"))
    first = listed.groupBy("block", "c_text").agg(F.min("ord").alias("ord"))
    return first.withColumn("c_sorted", sorted_tokens(F.col("c_text")))


def _search(texts: pa.Table, entries: pa.Table) -> pa.Table:
    """The best rank of each text of a piece among the entries of a part."""
    ranks: list[int] = []
    if texts.num_rows and entries.num_rows:
        known = Entries(list(zip(*(entries[c].to_pylist() for c in ("c_text", "c_sorted", "ord")))))
        ranks = known.best(list(zip(texts["k_text"].to_pylist(), texts["k_sorted"].to_pylist())))
    return texts.select(["block", "k_text"]).slice(0, len(ranks)).append_column("rank", pa.array(ranks, pa.int64()))


def best_match(keys: DataFrame, choices: DataFrame, block: str = "block", work: int = WORK, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Best reference entry for each text.

    ``keys`` holds distinct ``block`` and ``text``; ``choices`` holds ``block``,
    ``text`` and ``ord``, a whole number below 2**48 that is unique within the
    block. Returns ``block``, ``text``, ``score`` and ``ord``. Texts whose block
    has no entry come back with nulls, as do texts without a block. A text is
    compared whatever its length. The prepared reference list and the texts are
    stored, as later steps read them again.
    """
    importable(keys.sparkSession)
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = stored(_choices(choices, block), "entries")
    named = stored(keys.select(F.col(block).alias("block"), "text", comparable(F.col("text")).alias("k_text")), "texts")
    texts = named.select("block", "k_text").dropna().distinct().withColumn("k_sorted", sorted_tokens(F.col("k_text")))

    # Comparisons per block, from the texts and entries there are. A core builds few tries, however many tasks there are.
    cores = min(tasks, keys.sparkSession.sparkContext.defaultParallelism)
    asked = named.dropna().groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    listed = entries.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    met = asked.join(listed, "block").withColumn("compared", F.col("n").cast("double") * F.col("m"))
    share = F.col("compared") / met.agg(F.sum("compared")).scalar()
    busy = F.least(F.ceil(F.col("compared") / work), F.ceil(share * (PIECES_PER_TASK * cores)))
    sizes = met.select(
        "block",
        F.greatest(busy, F.ceil(F.col("n") / MOST_TEXTS)).cast("bigint").alias("pieces"),
        F.ceil(F.col("m") / most_entries).cast("bigint").alias("parts"),
    )
    sizes = stored(sizes, "pieces")

    def all_of(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))

    dealt = texts.join(sizes, "block").withColumn("piece", F.pmod(F.xxhash64("k_text"), F.col("pieces")))
    dealt = dealt.withColumn("part", all_of("parts")).select("block", "part", "piece", "k_text", "k_sorted")
    sent = entries.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("c_text"), F.col("parts")))
    sent = sent.withColumn("piece", all_of("pieces")).select("block", "part", "piece", "c_text", "c_sorted", "ord")
    # As many tasks as told: adaptive execution would merge what is small in bytes, and Spark cannot split a group.
    dealt, sent = (df.repartition(tasks, "block", "part", "piece") for df in (dealt, sent))
    groups = [df.groupBy("block", "part", "piece") for df in (dealt, sent)]
    found = groups[0].cogroup(groups[1]).applyInArrow(_search, "block string, k_text string, rank long")
    best = found.groupBy("block", "k_text").agg(F.min("rank").alias("rank"))
    return named.join(best, ["block", "k_text"], "left").select(
        F.col("block").alias(block),
        "text",
        (F.lit(100).cast("bigint") - F.shiftright(F.col("rank"), 48)).alias("score"),
        F.pmod(F.col("rank"), F.lit(ORD_SPACE)).alias("ord"),
    )
