"""Encoding and decoding with a piece vocabulary by a unigram Viterbi search.

Pieces lie in a double-array trie over their bytes. A text's best segmentation
has the largest sum of piece scores; a character that no piece covers costs
more than any piece and is written as its bytes' pieces. Spaces become the
whitespace marker, with one marker in front of the text. No piece holds a
marker after another character, and none a line feed, so the parts of a text
between them are searched one by one and remembered; so are parts that end
before a sign no piece holds behind a letter.
"""

from __future__ import annotations

import re
import string
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.workers import Recent, held, importable, slices

MARK = "▁"
PENALTY = 10.0  # of a character without a piece, below the lowest score
MARKED = MARK.encode()
KNOWN_PARTS = 120_000  # and as many older ones
BATCH_BYTES = 4 << 20


class Trie:
    """Double array: a state's child by byte b is ``base[state] + b + 1`` if ``check`` there is the state."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 10
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        lowest = 1  # places below are full, or nearly so
        waiting = [(0, 0, len(order), 0)]  # state, its keys, depth
        while waiting:
            state, first, end, depth = waiting.pop()
            while first < end and len(keys[order[first]]) == depth:
                value[state] = order[first]
                first += 1
            if first == end:
                continue
            groups, at = [], first
            while at < end:
                byte, begin = keys[order[at]][depth], at
                while at < end and keys[order[at]][depth] == byte:
                    at += 1
                groups.append((byte + 1, begin, at))
            while lowest < len(check) and check[lowest] >= 0:
                lowest += 1
            place = max(1, lowest - groups[0][0])
            tries = 0
            while True:
                if place + 257 >= len(check):
                    base += [0] * len(base)
                    value += [-1] * len(value)
                    check += [-1] * len(check)
                if all(check[place + code] < 0 for code, _, _ in groups):
                    break
                place += 1
                tries += 1
            if tries > 128:
                lowest = max(lowest, place)
            base[state] = place
            for code, begin, stop in groups:
                check[place + code] = state
                waiting.append((place + code, begin, stop, depth + 1))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, text: bytes, start: int) -> list[tuple[int, int]]:
        """(end, value) of all keys that the text has at ``start``."""
        base, check, value = self.base, self.check, self.value
        state, out = 0, []
        for at in range(start, len(text)):
            after = base[state] + text[at] + 1
            if check[after] != state:
                break
            state = after
            if value[state] >= 0:
                out.append((at + 1, value[state]))
        return out


class Codec:
    """Pieces of a model file; the file's own search is not used."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {i: model.id_to_piece(i) for i in plain}
        self.scores = {i: model.get_score(i) for i in plain}
        self.points = list(self.scores.values())
        self.unknown = min(self.scores.values()) - PENALTY
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        self.ids = list(pieces)
        self.trie = Trie([p.encode() for p in pieces.values()])
        self.written = {i: p.replace(MARK, " ").encode() for i, p in pieces.items()}
        self.written |= {i: bytes([b]) for b, i in self.bytes.items()}
        self.missing = model.unk_id()
        if any(MARK in p.lstrip(MARK) for p in pieces.values()):
            raise ValueError("a piece holds the marker after another character")
        lines = any("\n" in p for p in pieces.values())
        self.parts = re.compile(rb" +[^ ]*" if lines else rb" +[^ \n]*|\n|[^ \n]+")
        # Signs that no piece holds behind a letter or digit: between the two every segmentation has a border.
        behind = {b for p in pieces.values() for a, b in zip(p, p[1:]) if a.isascii() and a.isalnum()}
        signs = "".join(c for c in string.punctuation if c not in behind)
        self.inner = re.compile(rf"(?<=[A-Za-z0-9])(?=[{re.escape(signs)}])".encode() if signs else rb"(?!)")
        self.known, self.stems = Recent(KNOWN_PARTS), Recent(KNOWN_PARTS)

    def search(self, part: bytes) -> bytes:
        """Ids of the best segmentation of a part, as little-endian numbers of 4 bytes.

        Of equal ones, the one with the shorter last pieces.
        """
        text = part.replace(b" ", MARKED)
        base, check, value, points = self.trie.base, self.trie.check, self.trie.value, self.points
        n, unknown, low = len(text), self.unknown, -float("inf")
        best, back, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            if here == low:
                continue
            byte = text[at]
            alone = at + (1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4)
            if alone <= n and here + unknown > best[alone]:
                best[alone], back[alone], piece[alone] = here + unknown, at, -1
            state, end = 0, at
            while end < n:
                after = base[state] + text[end] + 1
                if check[after] != state:
                    break
                state, end = after, end + 1
                number = value[state]
                if number >= 0:
                    score = here + points[number]
                    if score >= best[end]:
                        best[end], back[end], piece[end] = score, at, number
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(self.ids[piece[n]])
            else:
                out += [self.bytes.get(b, self.missing) for b in reversed(text[back[n] : n])]
            n = back[n]
        return array("I", reversed(out)).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        split = [self.parts.findall(b" " + t.replace(MARKED, b" ")) if t else [] for t in texts]
        known = self.known
        new = {part: self.inner.split(part) for part in known.missing(set().union(*split))}
        for stem in self.stems.missing(set(chain.from_iterable(new.values()))):
            self.stems.young[stem] = self.search(stem)
        stems = self.stems.young
        known.young.update((part, b"".join([stems[s] for s in parts])) for part, parts in new.items())
        found = known.young.__getitem__
        return [b"".join(map(found, parts)) for parts in split]

    def decode(self, ids: list[int]) -> bytes:
        """The text, without the space that the first marker stands for. Ids that no piece has are left out."""
        written = self.written
        try:
            text = b"".join([written[i] for i in ids])
        except KeyError:
            text = b"".join([written.get(i, b"") for i in ids])
        return text[1:] if text[:1] == b" " else text


def codec(path: str) -> Codec:
    return held(f"pieces of {path}", lambda: Codec(path))


def lists(rows: list[bytes]) -> pa.Array:
    """Little-endian numbers of 4 bytes as an array of lists."""
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encoded(text: Column, path: str) -> Column:
    """Array of piece ids; empty for null and empty texts."""

    def encode(texts: pa.Array) -> pa.Array:
        know, parts = codec(path), []
        for part in slices(texts, BATCH_BYTES):
            parts.append(lists(know.encode(part)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    encode.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Said to be not deterministic, so that it is not computed again for each use of its result.
    return F.arrow_udf(encode, "array<int>").asNondeterministic()(text.cast("binary"))


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of piece ids; null for null. Bytes that are no text become replacement characters."""

    def decode(rows: pa.Array) -> pa.Array:
        know, flat, ends = codec(path), rows.values.to_numpy(), rows.offsets.to_numpy()
        texts = []
        # Row by row: a batch's ids as Python numbers would take ten times their room.
        for filled, first, end in zip(rows.is_valid().to_pylist(), ends.tolist(), ends[1:].tolist()):
            found = know.decode(flat[first:end].tolist()) if filled else None
            texts.append(None if found is None else found.decode("utf-8", "replace"))
        return pa.array(texts, pa.string())

    decode.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(decode, "string")(ids)


def encode_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key and ``ids``; other columns are left out, whatever their names."""
    importable(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").alias("id"), encoded(F.col(f"`{text}`"), path).alias("ids")).withColumnRenamed("id", key)


def decode_table(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: its key and ``text``; null for null ids, empty for none. Repeated rows stay, other columns are left out."""
    importable(rows.sparkSession)
    return rows.select(F.col(f"`{key}`").alias("id"), decoded(F.col(f"`{ids}`"), path).alias("text")).withColumnRenamed("id", key)


def coded(text: Column, path: str) -> Column:
    """``ids`` of a text and whether they decode to it again (``same``), in one go: the text goes to a worker once."""

    def code(texts: pa.Array) -> pa.Array:
        know, parts = codec(path), []
        for part in slices(texts, BATCH_BYTES):
            rows = know.encode(part)
            same = [
                know.decode(np.frombuffer(ids, "<i4").tolist()).decode("utf-8", "replace").encode() == whole.replace(MARKED, b" ")
                for ids, whole in zip(rows, part)
            ]
            parts.append(pa.StructArray.from_arrays([lists(rows), pa.array(same)], fields=list(CODED)))
        return pa.concat_arrays(parts) if parts else pa.array([], CODED)

    code.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(code, "ids array<int>, same boolean").asNondeterministic()(text.cast("binary"))


CODED = pa.struct([("ids", pa.list_(pa.int32())), ("same", pa.bool_())])


def code_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, ``n_pieces``, ``n_byte_pieces``, ``ids_hash`` and ``round_trip``.

    ``round_trip`` tells whether decoding gives the text again; a marker inside
    a text comes back as a space. Null texts count as empty: no pieces, and true.
    """
    importable(docs.sparkSession)
    know = codec(path)
    low, high = (min(know.bytes.values()), max(know.bytes.values())) if know.bytes else (-1, -2)
    rows = docs.select(F.col(f"`{key}`").alias("id"), coded(F.col(f"`{text}`"), path).alias("coded"))
    ids = F.col("coded.ids")
    return rows.select(
        F.col("id").alias(key),
        F.size(ids).cast("bigint").alias("n_pieces"),
        F.size(F.filter(ids, lambda i: i.between(low, high))).cast("bigint").alias("n_byte_pieces"),
        F.xxhash64(ids).alias("ids_hash"),
        F.col("coded.same").alias("round_trip"),
    )
