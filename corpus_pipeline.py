"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents its predecessor kept and works on all of them;
its result is written as Parquet and read again. The first four return
documents with all their columns, the last the pieces of the packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import exact_dedup, language_id, near_dedup, packing, quality_rules
from lanewise.llm.keeping import only, only_once
from lanewise.storage import stored

KEY, TEXT = "doc_id", "text"
LEAST_SHARE = 0.5  # of a document's main language
WORDS, PERCENT = 5, 80
TOKENIZER = "word_bpe_49k.json"
MEMO = 25_000  # words; executors still hold what the stages before have left in their heap


def one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one learned language has at least half; those without letters go."""
    found = language_id.language(F.col(TEXT), language_id.train(docs, KEY, TEXT, "lang"))
    return docs.where((found["lang"] != language_id.UNKNOWN) & (found["score"] >= LEAST_SHARE))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject."""
    rules = quality_rules.rules_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), KEY, TEXT)
    counts = quality_rules.counts(F.col(TEXT))
    return docs.where(~quality_rules.failed_base(counts) & quality_rules.kept_by(rules, counts))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return only_once(docs, stored(exact_dedup.exact_dedup(docs, KEY, TEXT), "kept"), KEY, TEXT)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return only(docs, near_dedup.near_dedup(docs, KEY, TEXT, WORDS, PERCENT).where("kept"), KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), KEY, TEXT, memo=MEMO)


STAGES = [
    ("language_id", one_language),
    ("quality_rules", good_quality),
    ("exact_dedup", distinct_texts),
    ("near_dedup", no_near_copies),
    ("packing", packed),
]

#: No stage but the third can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
