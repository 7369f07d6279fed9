"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is the log-odds of its rate in toxic against clean documents
with an informative Dirichlet prior, which pulls rare tokens to the corpus
rate. A document counts each of its tokens once, and of copies and near copies
with equal labels one counts, as they say nothing new. Of the log-odds counts
what lies ``SURE`` standard errors from zero; all other tokens share those of
what is left, a small negative number. Beginnings of ``STEM`` bytes are scored
like tokens and stand for tokens without a score, as toxic words have endings.

All maximal segments of a text are found in linear time (Ruzzo and Tompa). For
scores of this kind the best segment of a clean text of n tokens follows an
extreme-value distribution: its chance to reach S is 1 - exp(-K n exp(-L S))
(Karlin and Altschul). L solves sum(p exp(L s)) = 1 over clean tokens, K is fitted
to clean documents. A segment's evidence is L S - ln(K n); a text's evidence is
the sum over its significant passages, or that of its best one if none is. A
logistic curve, fitted to documents that the token scores have not seen, turns
evidence into a probability.

The model is fitted on ``SAMPLE`` rows, which bounds its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.hashing import windows, word_hashes
from lanewise.llm.workers import importable, slices
from lanewise.storage import stored

SAMPLE = 50_000  # labelled rows that the model is fitted on, at most
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4  # remainders of a key's checksum; all others give token scores
PRIOR = 0.01  # of all tokens is what the prior counts as, and half a one for each
SURE = 3.0  # standard errors
SLICE = 1 << 20  # bytes of text whose words are held at once
STEPS, LOWEST, HIGHEST = 4, -20, 40  # evidence is counted in steps for the logistic curve
PULL = 1e-3  # towards a flat curve
STEM = 4
HELD = 200_000  # tokens that a task counts at once
RUN = 3  # words of the runs that tell copies
#: Small letters and what is beyond ASCII stay, capitals become small, all else is a border.
FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


class Segment(NamedTuple):
    first: int  # token
    end: int
    score: float


class Model(NamedTuple):
    keys: np.ndarray  # sorted hashes of tokens and beginnings with a score of their own
    scores: np.ndarray
    rest: float  # score of all other tokens
    rate: float = 1.0  # L
    size: float = 1.0  # K
    slope: float = 0.0
    offset: float = 0.0


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def token_keys(words: list[bytes]) -> np.ndarray:
    return word_hashes(words).view(np.int64)


def stem_keys(words: list[bytes]) -> np.ndarray:
    return word_hashes([w[:STEM] + b"*" for w in words]).view(np.int64)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, from left to right, in linear time.

    A segment waits with the sum before it and the sum at its end. A new one
    meets the last waiting one with a smaller sum before it; if that ends lower
    than the new one, both and all between become one, which is tried again.
    """
    found: list[list[float]] = []  # [first, end, sum before, sum at the end, waiting one with a smaller sum before or -1]
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first = at
        while True:
            # Those skipped here are passed by their own pointers, so every pointer is followed once.
            place = len(found) - 1
            while place >= 0 and found[place][2] >= before:
                place = found[place][4]
            if place < 0 or found[place][3] >= total:
                found.append([first, at + 1, before, total, place])
                break
            first, before = found[place][0], found[place][2]
            del found[place:]
    return [(int(a), int(b), high - low) for a, b, low, high, _ in found]


def looked_up(keys: np.ndarray, model: Model) -> np.ndarray:
    """The scores of keys, not a number where they have none."""
    near = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
    return np.where(model.keys[near] == keys, model.scores[near], np.nan)


def segments(words: list[bytes], model: Model) -> list[Segment]:
    """Maximal segments of a text's tokens; tokens without a score of their own are taken as runs."""
    if not len(model.keys) or not words:
        return []
    scores = looked_up(token_keys(words), model)
    bare = np.isnan(scores).nonzero()[0]
    scores[bare] = looked_up(stem_keys([words[i] for i in bare.tolist()]), model)
    places = (~np.isnan(scores)).nonzero()[0]
    runs = np.empty(2 * len(places))
    runs[::2] = (np.diff(places, prepend=-1) - 1) * model.rest  # of other tokens before each
    runs[1::2] = scores[places]
    return [Segment(int(places[a // 2]), int(places[(b - 1) // 2]) + 1, score) for a, b, score in maximal_segments(runs.tolist())]


def evidence(found: list[Segment], n: int, model: Model) -> tuple[float, list[tuple[Segment, float]]]:
    """The text's evidence, and the significant passages with theirs."""
    least = -np.log(model.size * max(n, 1))
    each = [(s, float(model.rate * s.score + least)) for s in found]
    passages = [(s, e) for s, e in each if e > 0]
    if passages:
        return sum(e for _, e in passages), passages
    return max([e for _, e in each], default=float(least)), []


def probability(found: float, model: Model) -> float:
    bound = min(max(found, LOWEST), HIGHEST)
    return float(1 / (1 + np.exp(-(model.slope * bound + model.offset))))


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def sketch(texts: pa.Array) -> pa.Array:
    """The least hash of a text's runs of words: near copies mostly share it."""
    found = []
    for part in slices(texts, SLICE):
        for text in part:
            hashes = word_hashes(tokens(text))
            runs = windows(hashes, min(RUN, max(len(hashes), 1)))
            found.append(int(runs.min().view(np.int64)) if len(runs) else 0)
    return pa.array(found, pa.int64())


sketch.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int = SAMPLE) -> DataFrame:
    """(fold, toxic, text) of at most ``most`` labelled rows outside the held-out fold, chosen by a hash of the key.

    Of several labels of a key the highest counts; of rows with equal labels and
    equal sketches, that of the smallest key.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col("toxic")).dropna().where("toxic IN (0, 1)")
    known = known.groupBy("key").agg(F.max("toxic").cast("int").alias("toxic")).where(fold(F.col("key")) != HELD_OUT)
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    # ``most`` rows of two numbers, both times.
    met = rows.join(F.broadcast(chosen), "key").select("key", "toxic", F.arrow_udf(sketch, "bigint")("text").alias("sketch"))
    first = stored(met.groupBy("toxic", "sketch").agg(F.min("key").alias("key")).select("key", "toxic").distinct(), "labelled")
    return rows.join(F.broadcast(first), "key").select(fold(F.col("key")).alias("fold"), "toxic", "text")


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one task by label and by the keys of tokens and beginnings in them."""
    counts: tuple[dict[int, int], dict[int, int]] = ({}, {})

    def rows() -> Iterator[pa.RecordBatch]:
        for toxic, found in enumerate(counts):
            keys, n = pa.array(found, pa.int64()), pa.array(found.values(), pa.int64())
            zero = pa.array(np.zeros(len(found), np.int64))
            yield pa.RecordBatch.from_arrays([keys, n if toxic else zero, zero if toxic else n], ["key", "toxic", "clean"])
            found.clear()

    for batch in batches:
        for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"]):
            words, found = list(set(tokens(text.as_py()))), counts[toxic]
            for key in [*token_keys(words).tolist(), *np.unique(stem_keys(words)).tolist()]:
                found[key] = found.get(key, 0) + 1
            if len(found) > HELD:
                yield from rows()
    yield from rows()


def token_scores(rows: DataFrame) -> Model:
    """Scores of tokens from rows (toxic, text). Without documents of both kinds no token has a score."""
    counts = rows.select("toxic", "text").mapInArrow(_key_counts, "key long, toxic long, clean long")
    counts = stored(counts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "tokens")
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("toxic", "clean")]).first()
    if not totals["toxic"] or not totals["clean"]:
        return Model(np.empty(0, np.int64), np.empty(0), -1.0)
    every = totals["toxic"] + totals["clean"]
    prior = F.lit(0.5) + F.lit(PRIOR) * (F.col("toxic") + F.col("clean"))

    def odds(name: str) -> Column:
        seen = F.col(name) + prior
        return F.log(seen / (F.lit(totals[name] + PRIOR * every) - seen))

    delta = odds("toxic") - odds("clean")
    error = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    score = F.signum(delta) * (F.abs(delta) - F.lit(SURE) * error)
    told = counts.where(F.abs(delta) > F.lit(SURE) * error).select("key", score.alias("score"), "toxic", "clean")
    table = told.orderBy("key").toArrow()  # none is in less than a handful of the SAMPLE texts
    scores, toxic, clean = (table[c].to_numpy() for c in ("score", "toxic", "clean"))
    rest = np.log((totals["toxic"] - toxic.sum() + 1) / (totals["toxic"] + 1)) - np.log((totals["clean"] - clean.sum() + 1) / (totals["clean"] + 1))
    rest = min(float(rest), -1e-3)  # segments must end
    model = Model(table["key"].to_numpy(), scores, rest)
    return model._replace(rate=_rate(np.append(scores, rest), np.append(clean, totals["clean"] - clean.sum())))


def _rate(scores: np.ndarray, clean: np.ndarray) -> float:
    """The positive L with sum(p exp(L s)) = 1 over clean tokens, by bisection; each score counts as seen once more."""
    share = (clean + 1) / (clean + 1).sum()
    if scores.max() <= 0 or (share * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(high * scores)).sum() < 1:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return high


def _measured(columns: list[str], kinds: list[pa.DataType], row: Callable) -> Callable:
    """An Arrow function that gives a struct per text, from its number of tokens and its segments."""

    def measure(texts: pa.Array) -> pa.Array:
        rows = []
        for part in slices(texts, SLICE):
            for text in part:
                rows.append(row(tokens(text)))
        parts = zip(*rows) if rows else [()] * len(columns)
        return pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], columns)

    measure.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return measure


def calibrated(rows: DataFrame, model: Model) -> Model:
    """The model with K and the logistic curve fitted to rows (toxic, text) that its scores have not seen."""

    def best(words: list[bytes]) -> tuple[int, float]:
        return len(words), max((s.score for s in segments(words, model)), default=0.0)

    measure = F.arrow_udf(_measured(["n", "best"], [pa.int64(), pa.float64()], best), "struct<n:bigint,best:double>")
    clean = rows.where("toxic = 0").select(measure("text").alias("m")).select("m.*").where("n > 0")
    reached = F.sum(F.col("n") * F.exp(F.lit(-model.rate) * F.col("best")))
    seen, expected = clean.agg(F.count(F.lit(1)), reached).first()
    model = model._replace(size=(seen + 1) / ((expected or 0.0) + 1))

    def total(words: list[bytes]) -> tuple[float]:
        return (evidence(segments(words, model), len(words), model)[0],)

    measure = F.arrow_udf(_measured(["e"], [pa.float64()], total), "struct<e:double>")
    step = F.floor(F.least(F.greatest(F.col("m.e"), F.lit(LOWEST)), F.lit(HIGHEST)) * STEPS)
    found = rows.select("toxic", measure("text").alias("m")).groupBy(step.alias("step"), "toxic").count().collect()
    slope, offset = _logistic([((r["step"] + 0.5) / STEPS, r["toxic"], r["count"]) for r in found])
    return model._replace(slope=slope, offset=offset)


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset by Newton's method on counted (evidence, label, rows), smoothed by one row of each label."""
    x, y, n = (np.array(c, float) for c in zip(*rows, (0.0, 0, 0.5), (0.0, 1, 0.5)))
    both, beta = np.stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ both, -30, 30)))
        gradient = both @ (n * (y - p)) - PULL * beta
        step = np.linalg.solve((both * (n * p * (1 - p))) @ both.T + PULL * np.eye(2), gradient)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Model:
    importable(docs.sparkSession)
    rows = labelled(docs, labels, key, text, most)
    model = token_scores(rows.where(F.col("fold") != CALIBRATION))
    return calibrated(rows.where(F.col("fold") == CALIBRATION), model)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: its key, ``held_out``, ``score``, ``predicted`` and ``passages``.

    ``passages`` are the significant segments: first token, end, and evidence.
    Null and empty texts have no tokens and get the score of a text without
    evidence; a null key is not held out and never learned from. Equal texts
    get equal scores, repeated rows stay. Without labels of both kinds every
    score is that of the labels' own rate, or 0.5. Other columns are left out,
    whatever their names. The model is fitted while the result is being built.
    """
    model = train(docs, labels, key, text, most)

    def judge(words: list[bytes]) -> tuple[float, list]:
        found, passages = evidence(segments(words, model), len(words), model)
        return probability(found, model), [{"first": s.first, "end": s.end, "evidence": e} for s, e in passages]

    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
    shape = "struct<score:double,passages:array<struct<first:bigint,end:bigint,evidence:double>>>"
    measure = F.arrow_udf(_measured(["score", "passages"], [pa.float64(), kind], judge), shape)
    column = F.col(f"`{key}`")
    rows = docs.select(column.alias("key"), measure(F.col(f"`{text}`").cast("binary")).alias("m"))
    return rows.select(
        F.col("key").alias(key),
        F.coalesce(fold(F.col("key")) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("m.score").alias("score"),
        (F.col("m.score") >= 0.5).cast("int").alias("predicted"),
        F.col("m.passages").alias("passages"),
    )
