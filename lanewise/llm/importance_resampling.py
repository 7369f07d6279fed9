"""Resampling of documents towards a target distribution.

Features are runs of one to three words, hashed to buckets. One pass counts the
buckets of all documents and of all target texts; their smoothed log ratio per
bucket is an array of ``BUCKETS`` whole numbers, which every task gets. A second
pass scores a document by adding the array's values at its features. With noise
from the hash of the key added (Gumbel's trick), the highest scores are a draw
without replacement in proportion to the weights; ranks come from a distributed
radix sort of all scores.

A feature's checksum is put together from the checksums of its words: that of
``a b`` is that of ``a``, moved by as many bytes as follow, and that of `` b``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm import radix_sort
from lanewise.llm.workers import importable, slices
from lanewise.storage import stored

BUCKETS = 10_000
RUN = 3  # words of the longest feature
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
SLICE = 1 << 20  # bytes of text whose words are held at once
NEAR = 64  # bytes that a checksum is moved by a table; what is longer is moved in steps
#: Digits, small letters and what is beyond ASCII stay, capitals become small, all else is a border.
FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
POLYNOMIAL = 0xEDB88320  # fixed value of the checksum


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """[n, byte place, byte value]: what a byte of a checksum becomes when ``n`` zero bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    moves = np.empty((NEAR + 1, 4, 256), np.uint32)
    for place in range(4):
        moves[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for n in range(1, NEAR + 1):
        moves[n] = (moves[n - 1] >> np.uint32(8)) ^ one[moves[n - 1] & 255]
    return moves


def moved(sums: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums after ``by`` zero bytes, each by its own number."""
    moves = _moves()
    while True:
        n = np.minimum(by, NEAR)
        sums = (
            moves[n, 0, sums & 255]
            ^ moves[n, 1, (sums >> np.uint32(8)) & 255]
            ^ moves[n, 2, (sums >> np.uint32(16)) & 255]
            ^ moves[n, 3, sums >> np.uint32(24)]
        )
        by = by - n
        if not by.any():
            return sums


def feature_buckets(words: list[bytes], first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of the first word) of all features of a text's words.

    ``first`` tells texts apart if there are several: the number of each word's
    text. A feature lies in one text.
    """
    n = len(words)
    sums = np.fromiter(map(crc32, words), np.uint32, n)
    sizes = np.fromiter(map(len, words), np.int64, n)
    behind = moved(np.full(n, crc32(b" "), np.uint32), sizes) ^ sums  # of a space and the word
    run, place = sums, np.arange(n)
    buckets, places = [sums % BUCKETS], [place]
    for width in range(1, RUN):
        run = moved(run[: max(n - width, 0)], sizes[width:] + 1) ^ behind[width:]
        at = place[: len(run)]
        inside = slice(None) if first is None else first[: len(run)] == first[width:]
        buckets.append(run[inside] % BUCKETS)
        places.append(at[inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(places)


def _texts(texts: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """For runs of texts: words of each, buckets of all features, and the number of each feature's text."""
    for part in slices(texts, SLICE):
        split = [t.translate(FOLDED).split() for t in part]
        sizes = [len(words) for words in split]
        first = np.repeat(np.arange(len(split)), sizes)
        buckets, places = feature_buckets([w for words in split for w in words], first)
        yield sizes, buckets, first[places]


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket; a task adds up its own before anything is shuffled."""
    importable(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets, _ in _texts(batch.column(0)):
                total += np.bincount(buckets, minlength=BUCKETS)
        met = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["bucket", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    total = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS rows
        total[bucket] = n
    return total


def gains(all_texts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    s, t = all_texts.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(text: Column, gain: np.ndarray) -> Column:
    """Struct of ``n_words``, ``n_features`` and ``weight``, the sum of the gains at a text's features."""
    kind = ["n_words", "n_features", "weight"]

    def weigh(texts: pa.Array) -> pa.Array:
        columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in kind]
        for sizes, buckets, owner in _texts(texts):
            n = len(sizes)
            summed = np.zeros(n, np.int64)
            np.add.at(summed, owner, gain[buckets])
            for column, values in zip(columns, (np.array(sizes, np.int64), np.bincount(owner, minlength=n), summed)):
                column.append(values)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], kind)

    weigh.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(weigh, "struct<n_words:bigint,n_features:bigint,weight:bigint>")(text.cast("binary"))


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that the key alone decides, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``percent`` of the documents with ``least_words`` words are drawn, rounded
    down: those of the highest scores, ties to the smaller key, ranks from 1;
    ``rank`` is null for all others. Null and empty texts have no features and
    weight 0; they count as documents only if ``least_words`` is 0. A null key
    hashes like an empty one and is smaller than all others. Repeated rows get
    ranks of their own, repeated keys with equal scores in order of
    ``n_features``. Without target texts all counts of the target are 0. Keys
    are whole numbers; other columns are left out, whatever their names. Scores
    and passes are stored while the result is being built.
    """
    importable(docs.sparkSession)
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), weighed(F.col(f"`{text}`"), gain).alias("w"))
    scores = stored(rows.select("key", "w.*", (F.col("w.weight") + noise(F.col("key"), seed)).alias("score")), "scores")
    fit = F.col("n_words") >= least_words
    order = radix_sort.ranked(scores.where(fit).select((-F.col("score")).alias("below"), "key", "n_features", "weight"), ["below", "key"])
    drawn = scores.where(fit).count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    sorted_rows = order.select("key", "n_features", "weight", (-F.col("below")).alias("score"), rank.alias("rank"))
    rest = scores.where(~fit).select("key", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return sorted_rows.unionByName(rest).withColumnRenamed("key", key)
