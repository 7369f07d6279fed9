"""Rows of a table that a decision keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only(docs: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the keys of ``kept``; a null key equals a null key."""
    met = F.expr(f"d.`{key}` <=> k.`{key}`")
    return docs.alias("d").join(kept.select(key).alias("k"), met, "left_semi")


def only_once(docs: DataFrame, decisions: DataFrame, key: str, text: str) -> DataFrame:
    """The rows that ``decisions`` (key, ``raw_hash`` of the text, ``kept``) keep; rows equal in both stay once.

    Whether rows are repeated at all is asked of the decisions, which are small;
    only then are the documents grouped.
    """
    rows = decisions.select(key, "raw_hash", "kept")
    whole = F.coalesce(F.col(f"d.`{text}`"), F.lit(""))
    met = F.expr(f"d.`{key}` <=> k.`{key}`") & (F.xxhash64(whole) == F.col("k.raw_hash"))
    joined = docs.alias("d").join(rows.where("kept").alias("k"), met, "left_semi")
    repeated = rows.groupBy(key, "raw_hash").agg(F.count("*").alias("n")).where("n > 1")
    return joined if repeated.isEmpty() else joined.dropDuplicates([key, text])
