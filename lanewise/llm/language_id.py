"""Languages of a document as a mixture, by expectation-maximisation.

Training counts letter trigrams (with word borders) per language over all
training rows, hashed into a table of fixed size. A document's words are drawn
from its languages: a word's likelihood in a language is the product of its
trigrams'. Expectation-maximisation estimates the share of each language; the
language set is the one with the best likelihood less a price per language,
among the best single language and the sets of the k largest shares.

Counting and labelling go through the table once each and shuffle only counts;
the model has ``BUCKETS`` numbers per language.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.hashing import mixed
from lanewise.llm.workers import held, importable, release, runs, slices

BUCKETS = 1 << 15
SMOOTHING = 0.5
PRICE = 1.0  # of one more language, in natural logarithms of the number of words
ROUNDS = 12
UNKNOWN = "und"
WORDS_AT_ONCE = 150_000  # in a memo
WORDS_PER_RUN = 50_000
BATCH_BYTES = 1 << 20


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # log probability per bucket and language


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every letter of the words: the letter between its neighbours."""
    text = "\n".join(w.decode("utf-8", "replace").lower().replace("\n", " ") for w in words) + "\n"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    owner = np.cumsum(points == 10) - (points == 10)
    inside = letters()[points]
    shown = np.where(inside, points, 0).astype(np.uint64)
    before, after = np.roll(shown, 1), np.roll(shown, -1)
    gram = (before << np.uint64(42)) | (shown << np.uint64(21)) | after
    return owner[inside], (mixed(gram[inside]) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of a partition."""
    release()
    met: dict[str, Counter] = {}
    totals: dict[str, np.ndarray] = {}

    def settle() -> None:
        for lang, words in met.items():
            for first, end in runs([1] * len(words), WORDS_PER_RUN):
                owner, bucket = trigrams(list(islice(words, first, end)))
                weight = np.fromiter(islice(words.values(), first, end), np.int64, end - first)
                counted = np.bincount(bucket, weight[owner], BUCKETS).astype(np.int64)
                totals[lang] = totals.get(lang, 0) + counted
        met.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            met.setdefault(lang.as_py(), Counter()).update(text.as_py().split())
            if sum(map(len, met.values())) > WORDS_AT_ONCE:
                settle()
    settle()
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        columns = [pa.array([lang] * len(used)), pa.array(used), pa.array(counts[used])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])


def held_out(key: str) -> Column:
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows that have a text and a language and are not held out."""
    importable(docs.sparkSession)
    rows = docs.where(~F.coalesce(held_out(key), F.lit(False)))
    rows = rows.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("binary").alias("text")).dropna()
    counted = rows.mapInArrow(_count, "lang string, bucket bigint, n bigint")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    places = {name: i for i, name in enumerate(languages)}
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    owner = [places[name] for name in table["lang"].to_pylist()]
    np.add.at(counts, (table["bucket"].to_numpy(), np.array(owner, np.int64)), table["n"].to_numpy())
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _maximised(chance: np.ndarray, owner: np.ndarray, starts: np.ndarray, share: np.ndarray):
    """Shares and log likelihood per document after ``ROUNDS`` rounds."""
    sizes = np.diff(np.append(starts, len(owner)))[:, None]
    for _ in range(ROUNDS):
        part = chance * share[owner]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, starts) / sizes
    return share, np.add.reduceat(np.log((chance * share[owner]).sum(axis=1)), starts)


def mixtures(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Language shares of documents with ``lengths`` words, whose log likelihoods follow each other.

    Languages outside the chosen set have the share 0. Every length is over 0.
    """
    starts, owner = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
    scores = scores.astype(np.float64)
    scores -= scores.max(axis=1, keepdims=True)
    chance = np.maximum(np.exp(scores), 1e-300)
    n_langs, price = scores.shape[1], PRICE * np.log(lengths + 1.0)
    alone = np.add.reduceat(scores, starts)
    chosen = np.zeros_like(alone)
    chosen[np.arange(len(lengths)), alone.argmax(axis=1)] = 1.0
    value = alone.max(axis=1)
    full, best = _maximised(chance, owner, starts, np.full_like(alone, 1 / n_langs))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    going = np.flatnonzero(best - price > value)
    for k in range(2, n_langs + 1):
        if not len(going):
            break
        rows = np.isin(owner, going)
        sizes = lengths[going]
        share = np.where(rank[going] < k, full[going], 0.0)
        share /= share.sum(axis=1, keepdims=True)
        first = np.cumsum(sizes) - sizes
        share, likely = _maximised(chance[rows], np.repeat(np.arange(len(going)), sizes), first, share)
        likely -= (k - 1) * price[going]
        better = likely > value[going]
        chosen[going[better]], value[going[better]] = share[better], likely[better]
        going = going[best[going] - k * price[going] > value[going]]
    return chosen


class Labeller:
    """Language shares of texts; remembers the likelihoods of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.empty((1 << 12, len(self.model.languages)), np.float32)
        self.lettered = np.empty(1 << 12, bool)

    def learn(self, words: list[bytes]) -> None:
        if len(self.rows) + len(words) > WORDS_AT_ONCE and self.rows:
            self.forget()
        first, end = len(self.rows), len(self.rows) + len(words)
        while end > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.lettered = np.concatenate([self.lettered, np.empty_like(self.lettered)])
        owner, bucket = trigrams(words)
        sums = np.zeros((len(words), len(self.model.languages)), np.float32)
        if len(owner):
            at = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[owner[at]] = np.add.reduceat(self.model.scores[bucket], at)
        self.table[first:end] = sums
        self.lettered[first:end] = np.bincount(owner, minlength=len(words)) > 0
        self.rows.update(zip(words, range(first, end)))

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """One row per text; all 0 for a text without letters."""
        split = [t.split() for t in texts]
        words = [w for part in split for w in part]
        new = list(set(words).difference(self.rows))
        if len(self.rows) + len(new) > WORDS_AT_ONCE and self.rows:
            self.forget()
            new = list(set(words))
        if new:
            self.learn(new)
        place = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(texts)), [len(part) for part in split])
        used = self.lettered[place]
        lengths = np.bincount(owner[used], minlength=len(texts))
        out = np.zeros((len(texts), len(self.model.languages)))
        if used.any():
            out[lengths > 0] = mixtures(self.table[place[used]], lengths[lengths > 0])
        return out


def language(text: Column, model: Model) -> Column:
    """Struct of ``lang``, ``score`` (its share) and ``shares`` (of the chosen set, largest first)."""
    kind = pa.struct(
        [
            ("lang", pa.string()),
            ("score", pa.float64()),
            ("shares", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
        ]
    )
    name = f"languages of {uuid.uuid4()}"

    def label(texts: pa.Array) -> pa.Array:
        labeller, out = held(name, lambda: Labeller(model)), []
        for part in slices(texts, BATCH_BYTES):
            for row in labeller.shares(part) if model.languages else np.zeros((len(part), 1)):
                chosen = [i for i in np.argsort(-row, kind="stable").tolist() if row[i] > 0]
                shares = [{"lang": model.languages[i], "share": float(row[i])} for i in chosen]
                top = shares[0] if shares else {"lang": UNKNOWN, "share": 0.0}
                out.append({"lang": top["lang"], "score": min(1.0, top["share"]), "shares": shares})
        return pa.array(out, kind)

    label.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    shape = "struct<lang:string,score:double,shares:array<struct<lang:string,share:double>>>"
    return F.arrow_udf(label, shape)(text.cast("binary"))


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: its key, ``held_out``, ``lang_pred``, ``score`` and ``shares``.

    A text that is null, empty or has no letter is ``und`` with score 0, and so
    is any text if no row can be learned from. Equal texts get equal results.
    Rows without a key are learned from. Other columns are left out, whatever
    their names. The model is trained while the result is being built.
    """
    model = train(docs, key, text, lang)
    labelled = docs.select(
        F.col(f"`{key}`"),
        F.coalesce(held_out(key), F.lit(False)).alias("held_out"),
        language(F.col(f"`{text}`"), model).alias("l"),
    )
    columns = [F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.col("l.shares").alias("shares")]
    return labelled.select(F.col(f"`{key}`"), "held_out", *columns)
