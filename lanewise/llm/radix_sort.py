"""Ranks of all rows by a least-significant-digit radix sort.

The key is cut into digits. A pass is a stable counting sort by one digit:
places are cut into blocks of neighbouring rows, every block counts its digits,
prefix sums over (digit, block) say where the rows of a digit in a block begin,
and a row goes there plus the number of rows before it in its block that have
the same digit. After the pass of the highest digit a row's place is its rank.

A task never holds more of a digit than one block has, however often a key
occurs; the driver only sees the counts of one pass, a number per digit value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.storage import stored

BITS = 11  # of a digit
BLOCK = 1 << 12  # rows


def _pass(rows: DataFrame, digit: Column, block: Column, order: Sequence[Column]) -> DataFrame:
    """Rows with their ``place`` after a stable counting sort by ``digit``; they were in order of block, then ``order``."""
    marked = rows.select("*", digit.cast("int").alias("digit"), block.alias("block"))
    counted = stored(marked.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n")), "digits")
    begins, total = {}, 0
    for value, n in sorted(counted.groupBy("digit").agg(F.sum("n")).collect()):
        begins[value], total = total, total + n
    before = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = F.lit([begins.get(value, 0) for value in range(max(begins, default=0) + 1)])[F.col("digit")]
    starts = counted.select("digit", "block", (begin + before).alias("start"))
    within = F.row_number().over(Window.partitionBy("digit", "block").orderBy(*order))
    placed = marked.select("*", within.alias("within")).join(starts, ["digit", "block"])
    return placed.withColumn("place", F.col("start") + F.col("within") - 1).drop("digit", "block", "start", "within")


def ranked(rows: DataFrame, keys: Sequence[str], bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The rows with their ``place`` from 0, in the order of ``keys`` (whole numbers, ascending, nulls first).

    Rows that are equal in all keys are ordered by their other columns, and
    rows equal in everything get different places in any order. Passes cover
    the bits that the keys of these rows differ in; each is stored.
    """
    others = [c for c in rows.columns if c not in keys]
    bounds = rows.agg(F.count(F.lit(1)).alias("n"), *[F.min(k).alias(f"low{i}") for i, k in enumerate(keys)], *[F.max(k).alias(f"high{i}") for i, k in enumerate(keys)]).first()
    blocks = -(-max(bounds["n"], 1) // block)
    # Any first order is good as long as rows with equal keys meet and are ordered by the rest.
    at, order = F.pmod(F.xxhash64(*keys), F.lit(blocks)), [F.col(c) for c in (*keys, *others)]
    names = rows.columns
    for i in reversed(range(len(keys))):
        low, high = bounds[f"low{i}"], bounds[f"high{i}"]
        # A null is 0, the lowest value 1.
        reach = 0 if low is None else high - low + 1
        number = F.coalesce(F.col(keys[i]).cast("decimal(20,0)") - F.lit(low or 0) + 1, F.lit(0))
        for shift in range(0, max(reach.bit_length(), 1), bits):
            part = F.pmod(F.floor(number / F.lit(1 << shift)) if reach >= 1 << 62 else F.shiftright(number.cast("bigint"), shift), F.lit(1 << bits))
            rows = stored(_pass(rows, part, at, order), "sorted")
            at, order = F.floor(F.col("place") / block).cast("bigint"), [F.col("place")]
            rows = rows.select(*names, "place")
    return rows
