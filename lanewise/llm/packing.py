"""Best-fit packing of token sequences by bin completion.

Only the number of pieces of each length matters to the packing, and that is a
table of at most ``capacity`` rows whatever the data. On it, bin completion
takes the largest length left and looks for undominated ways to complete its
sequence, those without waste first. A branch is cut when its waste leaves no
room to beat the incumbent, which starts as best-fit decreasing, and where what
is left has been met before with no more sequences in use. The search ends at
the lower bound.

It is done twice. First a node tries ``WIDTH`` different completions, each as
often as the counts allow, which finds good packings of large tables soon. Then
it tries all undominated ones, as often as can be and, after those, once; if
this ends before ``NODES`` nodes, no packing has fewer sequences. Otherwise the
best packing found is taken.

The result is a list of patterns. Pieces are numbered within their length (in
hashed parts, so that a frequent length is spread), and the number finds the
pattern's slot. There are at most two patterns per length and search node, and
at most 63 different lengths in a pattern, which bounds what is sent out.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.workers import Recent, held, importable, slices
from lanewise.storage import stored

CAPACITY = 2048
NODES = 12_000
WIDTH = 6  # completions tried at a node in the first search
COMPARED = 64  # completions of a node that others are compared with; beyond, dominated ones may be tried, too
BYTES_PER_WORD = 8  # of text that is looked up at once, for each word of the memo
KNOWN_WORDS = 500_000  # in a worker, and as many older ones, and as many of their pieces
# Fixed values of the vocabulary's pre-tokenizer; whatever is cut here is encoded by the library.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def normal(text: str) -> str:
    """Composed form in lower case, each character by itself."""
    if text.isascii():
        return text.lower()
    return "".join(map(str.lower, unicodedata.normalize("NFC", text)))


class Pattern(NamedTuple):
    times: int
    items: tuple[tuple[int, int], ...]  # (length, how many)


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that are needed at least; ``counts`` by length, from 0 to the capacity."""
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for small in range(half + 1):
        large = int(number[-1] - number[capacity - small]) if small else 0
        middle = int(number[capacity - small] - number[half])
        room = middle * capacity - int(total[capacity - small] - total[half])
        rest = int(total[half] - (total[small - 1] if small else 0))
        best = max(best, large + middle + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best-fit decreasing, whole classes of equal sequences at a time."""
    capacity = len(counts) - 1
    bins: dict[int, dict[tuple, int]] = {}  # room left: what is inside: how many

    def put(room: int, items: tuple, times: int) -> None:
        if times:
            inside = bins.setdefault(room, {})
            inside[items] = inside.get(items, 0) + times

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for room in sorted(r for r in bins if r >= size):
            for items, times in list(bins[room].items()):
                if not left:
                    break
                most = room // size
                full = min(times, left // most)
                put(room - most * size, (*items, (size, most)), full)
                left -= full * most
                used = full
                if full < times and left:
                    put(room - left * size, (*items, (size, left)), 1)
                    used, left = full + 1, 0
                bins[room][items] -= used
                if not bins[room][items]:
                    del bins[room][items]
            if not bins[room]:
                del bins[room]
        most = capacity // size
        put(capacity - most * size, ((size, most),), left // most)
        if left % most:
            put(capacity - left % most * size, ((size, left % most),), 1)
    return [Pattern(times, items) for inside in bins.values() for items, times in inside.items()]


def _fits_into(small: tuple, large: tuple) -> bool:
    """Whether the items of ``small`` can be put into the items of ``large``: it is dominated."""
    pieces = sorted((s for s, k in small for _ in range(k)), reverse=True)
    rooms = [s for s, k in large for _ in range(k)]
    for piece in pieces:
        fitting = [i for i, room in enumerate(rooms) if room >= piece]
        if not fitting:
            return False
        i = min(fitting, key=rooms.__getitem__)
        rooms[i] -= piece
    return True


def _reach(sizes: list[int], counts: np.ndarray, room: int) -> list[int]:
    """For the first sizes, none to all of them: the sums up to ``room`` that their items can make, as bits."""
    reach, mask = [1], (1 << room + 1) - 1
    for size in sizes:
        bits, left, step = reach[-1], min(int(counts[size]), room // size), 1
        while left:
            take = min(step, left)
            bits |= bits << take * size & mask
            left, step = left - take, step * 2
        reach.append(bits)
    return reach


def completions(counts: np.ndarray, room: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """Undominated sets of items for ``room``, the fullest with the largest items first."""
    sizes = np.flatnonzero(counts[: room + 1]).tolist()
    reach = _reach(sizes, counts, room)

    def filled(top: int, target: int) -> list[tuple[int, int]]:
        items = []
        for i in range(top, 0, -1):
            if not target:
                break
            size = sizes[i - 1]
            for k in range(min(int(counts[size]), target // size), -1, -1):
                if reach[i - 1] >> target - k * size & 1:
                    break
            if k:
                items.append((size, k))
                target -= k * size
        return items

    given: list[tuple] = []
    full = tuple(filled(len(sizes), reach[-1].bit_length() - 1))
    yield full
    given.append(full)
    for i in range(len(sizes), 0, -1):
        if len(given) >= WIDTH:
            return
        size = sizes[i - 1]
        below = (reach[i - 1] & (1 << room - size + 1) - 1).bit_length() - 1
        other = ((size, 1), *filled(i - 1, below))
        if not any(_fits_into(other, g) for g in given):
            yield other
            given.append(other)


def fillings(counts: np.ndarray, room: int, waste: int) -> Iterator[tuple[tuple[int, int], ...] | None]:
    """All undominated sets of items for ``room`` that waste at most ``waste``, the fullest first, lazily; null for a dominated one."""
    sizes = np.flatnonzero(counts[: room + 1]).tolist()
    reach = _reach(sizes, counts, room)

    def of_sum(top: int, target: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if not target:
            yield ()
        while target and top and reach[top] >> target & 1:
            size, top = sizes[top - 1], top - 1
            for k in range(min(int(counts[size]), target // size), 0, -1):
                if reach[top] >> target - k * size & 1:
                    for more in of_sum(top, target - k * size):
                        yield ((size, k), *more)

    given: list[tuple] = []
    for total in range(room, max(room - waste, 0) - 1, -1):
        if reach[-1] >> total & 1:
            for found in of_sum(len(sizes), total):
                if any(_fits_into(found, g) for g in given):
                    yield None
                    continue
                yield found
                if len(given) < COMPARED:
                    given.append(found)


def bin_completion(counts: np.ndarray, nodes: int = NODES) -> list[Pattern]:
    """Patterns that use up ``counts`` (by length, from 0 to the capacity) in few sequences."""
    best = best_fit(counts)
    for whole in (False, True):
        if sum(p.times for p in best) == lower_bound(counts):
            break
        best = _search(counts, best, nodes, whole)
    return best


def _search(counts: np.ndarray, best: list[Pattern], nodes: int, whole: bool) -> list[Pattern]:
    """The best packing within ``nodes`` nodes, ``best`` if none has fewer sequences; ``whole`` tries all completions."""
    capacity = len(counts) - 1
    total = int((counts * np.arange(capacity + 1)).sum())
    least, fewest = lower_bound(counts), sum(p.times for p in best)
    met: dict[bytes, int] = {}  # what is left: the fewest sequences in use; at most one for each node

    def children(left: np.ndarray, waste: int) -> Iterator[Pattern | None]:
        size = int(np.flatnonzero(left)[-1])
        rest, again = left.copy(), []
        rest[size] -= 1
        room = capacity - size
        ways = fillings(rest, room, (fewest - 1) * capacity - total - waste) if whole else completions(rest, room)
        for more in ways:
            if more is None:
                yield None
                continue
            items: dict[int, int] = {size: 1}
            for s, k in more:
                items[s] = items.get(s, 0) + k
            pattern = Pattern(min(int(left[s]) // k for s, k in items.items()), tuple(items.items()))
            yield pattern
            if whole and pattern.times > 1:
                again.append(pattern.items)
        # Once, and then whatever comes: with the first way this covers every number of times.
        for items in again:
            yield Pattern(1, items)

    path: list[Pattern] = []
    stack = [(counts.copy(), children(counts, 0), 0, 0)]  # what is left, ways on, waste and sequences so far
    while stack and nodes and fewest > least:
        left, ways, waste, used = stack[-1]
        try:
            pattern = next(ways)
        except StopIteration:
            stack.pop()
            if path:
                path.pop()
            continue
        nodes -= 1
        if pattern is None:
            continue
        more = waste + pattern.times * (capacity - sum(s * k for s, k in pattern.items))
        number = used + pattern.times
        after = left.copy()
        for s, k in pattern.items:
            after[s] -= pattern.times * k
        if not after.any():
            if number < fewest:
                fewest, best = number, [*path, pattern]
        elif more <= (fewest - 1) * capacity - total:
            if whole:
                state = hashlib.blake2b(after.tobytes(), digest_size=16).digest()
                if met.get(state, number + 1) <= number:
                    continue
                met[state] = number
            path.append(pattern)
            stack.append((after, children(after, more), more, number))
    return best


class Slots(NamedTuple):
    """Where the pieces of a length go, by their number within it; sorted by ``code``."""

    code: np.ndarray  # length and first number
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def slots(patterns: list[Pattern]) -> Slots:
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern in patterns:
        offset = 0
        for size, k in pattern.items:
            first = given.get(size, 0)
            rows.append(((size << 48) | first, first, k, sequence, offset))
            given[size] = first + k * pattern.times
            offset += k * size
        sequence += pattern.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Slots(*table.T)


def _place(table: Slots):
    kind = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        size, rank = length.to_numpy().astype(np.int64), number.to_numpy().astype(np.int64)
        at = np.searchsorted(table.code, (size << 48) | rank, side="right") - 1
        turn, inside = np.divmod(rank - table.first[at], table.each[at])
        columns = [pa.array(table.sequence[at] + turn), pa.array(table.offset[at] + inside * size)]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    place.__annotations__ = {"length": pa.Array, "number": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "struct<sequence_id:bigint,offset:bigint>")


class Ids:
    """Token ids of texts by the library, as little-endian numbers of 4 bytes.

    White space in ASCII borders on no token and composes with nothing, so a
    text's ids are those of its words, and a word's are those of the pieces its
    pre-tokenizer finds. The library encodes each new piece; a word in which a
    special token may lie is encoded as a whole.
    """

    def __init__(self, path: str, memo: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pieces = Recent(memo), Recent(memo)

    def learn(self, known: Recent, texts: set[str]) -> None:
        new = known.missing(texts)
        found = self.tokenizer.encode_batch(new, add_special_tokens=False)
        known.young.update((t, array("I", e.ids).tobytes()) for t, e in zip(new, found))

    def of(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        pieces: dict[bytes, list[str]] = {}
        for word in self.words.missing(set().union(*split)):
            if word.isalpha():  # of bytes: letters in ASCII only
                pieces[word] = [word.lower().decode()]
            elif b"<|" in word:
                pieces[word] = [word.decode("utf-8", "replace")]
            else:
                pieces[word] = PIECES.findall(normal(word.decode("utf-8", "replace")))
        self.learn(self.pieces, set(chain.from_iterable(pieces.values())))
        words, known = self.words.young, self.pieces.young
        words.update((w, b"".join([known[p] for p in parts])) for w, parts in pieces.items())
        return [b"".join(map(words.__getitem__, found)) for found in split]


def pieces(text: Column, path: str, capacity: int, end: int, memo: int = KNOWN_WORDS) -> Column:
    """Array of a text's pieces: ``piece``, ``start``, ``length`` and ``ids_crc32``."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kind, closing = pa.list_(pa.struct(fields)), np.array([end], "<u4").tobytes()

    def cut(texts: pa.Array) -> pa.Array:
        out, known = [], held(f"{memo} ids of {path}", lambda: Ids(path, memo))
        for part in slices(texts, BYTES_PER_WORD * memo):
            for found in known.of(part):
                found += closing
                row = []
                for i, at in enumerate(range(0, len(found), 4 * capacity)):
                    cut_off = found[at : at + 4 * capacity]
                    row.append((i, at // 4, len(cut_off) // 4, zlib.crc32(cut_off)))
                out.append(row)
        flat = [pa.array([r[i] for row in out for r in row], f[1]) for i, f in enumerate(fields)]
        starts = np.cumsum([0, *map(len, out)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(flat, fields=list(kind.value_type)))

    cut.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    shape = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
    return F.arrow_udf(cut, shape)(text.cast("binary"))


def pack(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = 0,
    memo: int = KNOWN_WORDS,
) -> DataFrame:
    """One row per piece: its key, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its token ids and the id ``end``; a null or empty text is that
    id alone. Longer documents are cut into pieces of ``capacity``. Repeated
    rows and null keys are packed like others; an empty table gives no rows.
    Other columns are left out, whatever their names. Pieces are written to the
    shared folder before they are packed. A larger ``memo`` of words costs memory
    in each worker and saves encoding words again; results are the same.
    """
    spark = docs.sparkSession
    importable(spark)
    listed = pieces(F.col(f"`{text}`"), path, capacity, end, memo)
    cut = docs.select(F.col(f"`{key}`").alias("id"), F.explode(listed).alias("p"))
    found = stored(cut.select("id", "p.*"), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    table = slots(bin_completion(counts))

    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = found.withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(parts)))
    sums = spread.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32")
    numbered = spread.withColumn("within", F.row_number().over(inside)).join(sums, ["length", "part"])
    number = F.col("before") + F.col("within") - 1
    placed = numbered.withColumn("place", _place(table)("length", number))
    return placed.select(
        F.col("id").alias(key), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"
    )
