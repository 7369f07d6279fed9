"""Token counts of whole texts from chunks whose state maps are composed.

``transducer`` compiles the vocabulary; its transitions carry the tokens they
settle. White space leads from every state back to the start, so the state map
of a chunk is a constant behind its first white space. A map is kept as three
numbers: where the chunk's first word ends (what comes before still depends on
the state on entry), the tokens between, and where its unfinished last word
starts. Maps of neighbours compose, and composition is associative: the counts
at all chunk ends come from a prefix scan in a tree of pairs.

Rows stay where they are: nothing is shuffled, and a worker holds a batch of
rows and its memo of words, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm import transducer
from lanewise.llm.workers import held, importable

CHUNK = 1 << 16
SPACES = b" \t\n\x0b\x0c\r"


class Map(NamedTuple):
    """State map of the bytes from ``start`` to ``end``; ``inner`` is None without white space."""

    start: int
    head: int
    inner: int | None
    tail: int
    end: int


class Scan:
    """Token counts of one text up to the end of each chunk."""

    def __init__(self, text: bytes, count: Callable[[bytes], int], chunk: int = CHUNK):
        self.text, self.count = text, count
        self.maps = [self.chunk_map(i, min(i + chunk, len(text))) for i in range(0, len(text), chunk)]

    def chunk_map(self, start: int, end: int) -> Map:
        chunk = self.text[start:end]
        words = chunk.split()
        if len(words) == 1 and len(words[0]) == len(chunk):
            return Map(start, end, None, end, end)
        head = tail = 0
        if words and chunk[0] not in SPACES:
            head = len(words.pop(0))
        if words and chunk[-1] not in SPACES:
            tail = len(words.pop())
        return Map(start, start + head, sum(map(self.count, words)), end - tail, end)

    def compose(self, a: Map, b: Map) -> Map:
        if a.inner is None:
            return Map(a.start, b.head, b.inner, b.tail, b.end)
        if b.inner is None:
            return Map(a.start, a.head, a.inner, a.tail, b.end)
        between = self.count(self.text[a.tail : b.head])
        return Map(a.start, a.head, a.inner + between + b.inner, b.tail, b.end)

    def prefixes(self, maps: list[Map]) -> list[Map]:
        if len(maps) < 2:
            return maps
        pairs = self.prefixes([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]))
        return out

    def applied(self, m: Map) -> int:
        """The tokens of the bytes a map covers, if a text starts and ends there."""
        if m.inner is None:
            return self.count(self.text[m.start : m.end])
        return self.count(self.text[m.start : m.head]) + m.inner + self.count(self.text[m.tail : m.end])

    def total(self) -> int:
        return self.applied(self.prefixes(self.maps)[-1]) if self.maps else 0

    def at_chunk_ends(self) -> list[int]:
        return [self.applied(m) for m in self.prefixes(self.maps)]


def n_tokens(text: Column, path: str, chunk: int = CHUNK) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts."""

    def count(texts: pa.Array) -> pa.Array:
        word = held(f"token counts of {path}", lambda: transducer.counts(path)).__getitem__
        return pa.array([Scan(t.as_py() or b"", word, chunk).total() for t in texts], pa.int64())

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "bigint")(text.cast("binary"))


def token_counts(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048, chunk: int = CHUNK
) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows stay repeated,
    null keys stay null, and other columns are left out, whatever their names.
    """
    importable(docs.sparkSession)
    column = F.col(f"`{text}`")
    counted = docs.select(
        F.col(f"`{key}`"),
        F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint").alias("n_bytes"),
        n_tokens(column, path, chunk).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
