"""Quality rules learned as an ordered decision list.

Sequential covering: grow one conjunction of thresholds on two thirds of the
rows not yet covered, adding the condition with the largest information gain;
prune it on the other third by leaving out its last conditions; keep it if
enough of what it covers there is rejected by label; take away what it covers;
repeat. The list becomes one conditional expression in Spark.

Statistics of a text come from one pass over its words and are shuffled
nowhere. Rules are fitted on ``SAMPLE`` labelled rows at most.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.hashing import windows, word_hashes
from lanewise.llm.workers import hand_back, importable, release

SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"!?"
WINDOW = 5
SAMPLE = 20_000  # labelled rows that rules are fitted on, at most
CUTS = 48  # thresholds tried per feature
CONDITIONS = 4
PRECISION = 0.95
SUPPORT = 5

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_most_common",
    "n_same_next",
    "n_capitals",
    "n_marks",
    "n_letters",
)
#: Feature: (count, count it is divided by). None depends on how long an even text is.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "most_common_share": ("n_most_common", "n_words"),
    "same_next_share": ("n_same_next", "n_words"),
    "capital_share": ("n_capitals", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "letter_share": ("n_letters", "word_chars"),
}


class Condition(NamedTuple):
    feature: str
    above: bool
    cut: float


class Rule(NamedTuple):
    conditions: tuple[Condition, ...]
    covered: int
    rejected: int


def text_counts(text: bytes, points: int) -> tuple[int, ...]:
    """``COUNTS`` of a text in UTF-8 with ``points`` code points."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    hashes = word_hashes(words)
    groups = np.unique(hashes, return_counts=True)[1]
    lines = [line for line in text.split(b"\n") if line.strip()]
    _, place, count = np.unique(windows(hashes, WINDOW), return_inverse=True, return_counts=True)
    repeated = np.zeros(n, bool)
    if len(place):
        again = count[place] > 1
        for i in range(WINDOW):
            repeated[i : n - WINDOW + 1 + i] |= again
    ascii_letters = len(text) - len(text.translate(None, CAPITALS + CAPITALS.lower()))
    beyond = points - len(text.translate(None, bytes(range(128, 256))))
    return (
        n,
        points - len(text) + sum(map(len, words)),
        sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))),
        len(lines) - len(set(lines)),
        int(repeated.sum()),
        len(lines),
        int(groups.max()),
        int((hashes[1:] == hashes[:-1]).sum()),
        len(text) - len(text.translate(None, CAPITALS)),
        len(text) - len(text.translate(None, MARKS)),
        ascii_letters + beyond,
    )


def counts(text: Column) -> Column:
    """Struct of ``COUNTS``; all 0 for null."""
    kind = pa.struct([(name, pa.int64()) for name in COUNTS])

    def count(texts: pa.Array, points: pa.Array) -> pa.Array:
        release()
        rows = [text_counts(t.as_py() or b"", p or 0) for t, p in zip(texts, points.to_pylist())]
        columns = zip(*rows) if rows else [()] * len(COUNTS)
        hand_back()
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind))

    count.__annotations__ = {"texts": pa.Array, "points": pa.Array, "return": pa.Array}
    shape = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"
    return F.arrow_udf(count, shape)(text.cast("binary"), F.length(text))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int = SAMPLE) -> tuple:
    """Features and labels of at most ``most`` labelled rows, chosen by a hash of the key.

    Rows that fail the base rules are left out. A key with several labels
    counts as its lowest.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col("quality")).dropna().where("quality IN (0, 1)")
    known = known.groupBy("key").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most)
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    source = source.join(F.broadcast(chosen), "key")  # ``most`` rows of two numbers
    source = source.groupBy("key").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    table = source.select("key", "quality", counts(F.col("text")).alias("c"))
    table = table.where(~failed_base(F.col("c"))).select("key", "quality", "c.*")
    rows = table.orderBy(F.xxhash64("key"), "key").toArrow()
    values = [
        rows[a].to_numpy() / np.maximum(rows[b].to_numpy(), 1) if rows.num_rows else np.empty(0)
        for a, b in FEATURES.values()
    ]
    return np.stack(values, axis=1), rows["quality"].to_numpy() == 0


def _holds(values: np.ndarray, condition: Condition) -> np.ndarray:
    column = values[:, list(FEATURES).index(condition.feature)]
    return column > condition.cut if condition.above else column <= condition.cut


def _covered(values: np.ndarray, conditions) -> np.ndarray:
    return reduce(np.logical_and, (_holds(values, c) for c in conditions), np.ones(len(values), bool))


def _candidates(values: np.ndarray) -> list[Condition]:
    out = []
    for i, name in enumerate(FEATURES):
        met = np.unique(values[:, i])
        between = (met[1:] + met[:-1]) / 2
        if len(between) > CUTS:
            between = np.unique(between[np.linspace(0, len(between) - 1, CUTS).astype(int)])
        out += [Condition(name, above, float(cut)) for cut in between for above in (True, False)]
    return out


def _grown(values: np.ndarray, bad: np.ndarray) -> list[Condition]:
    conditions: list[Condition] = []
    inside = np.ones(len(values), bool)
    while len(conditions) < CONDITIONS and bad[inside].any() and not bad[inside].all():
        here, target = values[inside], bad[inside]
        tried = _candidates(here)
        if not tried:
            break
        held = np.stack([_holds(here, c) for c in tried])
        p, n = (held & target).sum(axis=1), (held & ~target).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = p * (np.log2(p / (p + n)) - np.log2(target.mean()))
        gain = np.where(p > 0, gain, 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        conditions.append(tried[best])
        inside[inside] = held[best]
    return conditions


def learn(values: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Rules, in order, that reject; rows come in random order. Empty without labels of both kinds."""
    rules: list[Rule] = []
    growing = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), bool)
    while bad[left].any():
        conditions = _grown(values[left & growing], bad[left & growing])
        if not conditions:
            break

        def worth(length: int) -> float:
            held = _covered(values, conditions[:length]) & left & ~growing
            p, n = int((held & bad).sum()), int((held & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        length = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        conditions = conditions[:length]
        held = _covered(values, conditions) & left
        p, total = int((held & bad).sum()), int(held.sum())
        if p < SUPPORT or p < PRECISION * total or worth(length) < 2 * PRECISION - 1:
            break
        rules.append(Rule(tuple(conditions), total, p))
        left &= ~held
    return rules


def kept_by(rules: list[Rule], of: Column) -> Column:
    """The decision list over a struct of counts: false where the first rule that holds rejects."""

    def feature(name: str) -> Column:
        a, b = FEATURES[name]
        return of[a] / F.greatest(of[b], F.lit(1))

    verdict = None
    for rule in rules:
        held = [feature(c.feature) > c.cut if c.above else feature(c.feature) <= c.cut for c in rule.conditions]
        branch = reduce(Column.__and__, held)
        verdict = F.when(branch, False) if verdict is None else verdict.when(branch, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def failed_base(of: Column) -> Column:
    """Fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (of["n_words"] < 10) | (100 * of["n_repeat_words"] > 20 * of["n_words"])


def rules_from(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> list[Rule]:
    importable(docs.sparkSession)
    return learn(*labelled(docs, labels, key, text))


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, ``COUNTS``, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Equal texts get
    equal results; with no usable label there are no learned rules. Other
    columns are left out, whatever their names. Rules are learned while the
    result is being built.
    """
    rules = rules_from(docs, labels, key, text)
    measured = docs.select(F.col(f"`{key}`").alias("id"), counts(F.col(f"`{text}`")).alias("c"))
    failed = failed_base(F.col("c"))
    kept = ~failed & kept_by(rules, F.col("c"))
    return measured.select(F.col("id").alias(key), "c.*", failed.alias("base_failed"), kept.alias("kept"))
