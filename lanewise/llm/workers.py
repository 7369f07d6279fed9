"""What the operators of this subpackage share on Spark's workers."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where it is installed."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows as (first, end) so that a run's sizes add up to about ``most``."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def slices(texts: pa.Array, most: int) -> Iterator[list[bytes]]:
    """The values of a binary array in lists of about ``most`` bytes; null is empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for first, end in runs(sizes, most):
        yield [t or b"" for t in texts.slice(first, end - first).to_pylist()]


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What an operator keeps in a worker from task to task; that of any other operator is given up."""
    if name not in _held:
        _held.clear()
        hand_back()
        _held[name] = make()
        hand_back()
    return _held[name]


def release() -> None:
    """Give up what another operator has kept."""
    if _held:
        _held.clear()
        hand_back()


def hand_back() -> None:
    """Return free memory to the system; a worker outlives the operators it runs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Recent:
    """Results for keys met lately: the younger ones, and an older generation to take from.

    When there are ``most`` young ones they become the older generation, so keys
    that come again and again are never lost and the number is bounded.
    """

    def __init__(self, most: int):
        self.young: dict = {}
        self.old: dict = {}
        self.most = most

    def missing(self, keys: set) -> list:
        """The keys without a result; all others are among the young afterwards."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        out, old, young = [], self.old, self.young
        for key in keys.difference(young):
            result = old.get(key)
            if result is None:
                out.append(key)
            else:
                young[key] = result
        return out
