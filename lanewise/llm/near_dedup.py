"""Near duplicates: fast similarity sketches, banding, exact verification.

A document is the set of its word shingles, each a 64-bit hash of word hashes.
The sketch has ``SIZE`` coordinates that are filled in rounds: in round r every
shingle falls into one hashed coordinate, and a coordinate keeps the smallest
(round, hash) it has met. After ``SIZE`` random rounds, round r fills
coordinate r - ``SIZE`` with all shingles, so every coordinate is filled after
at most twice ``SIZE`` rounds; large sets need one or two. A coordinate of two
sets agrees with a probability of their similarity, and the share of agreeing
coordinates is concentrated around it as for independent samples.

1. Equal sets become one class, named by its smallest key.
2. Classes that agree in all coordinates of a band share a bucket. Each bucket's
   smallest class is compared with the others: one row per member, not per pair.
3. Only buckets whose members are still in different components go on. They are
   dealt out in blocks; each pair of blocks is one task's group. A group
   compares pairs from different components, in the first band they share, if
   their sketches leave a link possible, and unites what it links.
4. Components over all links.

All links are decided on full sets, which are made again from the texts of the
classes that share a bucket. Bands are chosen so that a pair at the limit is
missed with a probability below ``MISSED``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.components import components
from lanewise.llm.hashing import mixed, step, windows, word_hashes
from lanewise.llm.workers import hand_back, importable, release, slices
from lanewise.storage import stored

SIZE = 128
MISSED = 1e-6
BLOCK = 1024
BATCH_BYTES = 1 << 20
SIGMAS = 6

LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)
UNFILLED = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands(percent: int, size: int = SIZE, missed: float = MISSED) -> tuple[int, int]:
    """(bands, coordinates per band): as many per band as the limit allows."""
    s = percent / 100
    fits = [r for r in range(1, size + 1) if (1 - s**r) ** (size // r) <= missed]
    rows = max(fits, default=1)
    return size // rows, rows


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text."""
    hashes = word_hashes((text or b"").lower().split())
    return np.unique(windows(hashes, min(words, len(hashes)))) if len(hashes) else hashes


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """One row of ``size`` 32-bit coordinates per set; empty sets get zeros."""
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    items = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    best = np.full((len(sets), size), UNFILLED)
    best[lengths == 0] = 0
    flat = best.reshape(-1)
    for turn in range(2 * size):
        if not len(items):
            break
        seeded = mixed(items + step(turn + 1))
        if turn < size:
            place = ((seeded >> HALF) * np.uint64(size)) >> HALF
        else:
            place = np.full(len(items), turn - size, np.uint64)
        np.minimum.at(flat, owner * size + place.astype(np.int64), np.uint64(turn << 32) | (seeded & LOW))
        still = (best == UNFILLED).any(axis=1)
        if not still.all():
            kept = still[owner]
            items, owner = items[kept], owner[kept]
    return (mixed(best + step(1)) >> HALF).astype("<u4")


def _profile(words: int):
    kind = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])

    def profile(texts: pa.Array) -> pa.Array:
        release()
        out = []
        for part in slices(texts, BATCH_BYTES):
            sets = [shingle_set(t, words) for t in part]
            for s, row in zip(sets, sketches(sets)):
                if len(s):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    out.append({"n": len(s), "digest": digest, "sketch": row.tobytes()})
                else:
                    out.append({"n": 0, "digest": None, "sketch": None})
        hand_back()
        return pa.array(out, kind)

    profile.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(profile, "struct<n:bigint,digest:binary,sketch:binary>")


def _full_set(words: int):
    def full(texts: pa.Array) -> pa.Array:
        data, ends = bytearray(), [0]  # one buffer, as the sets of a batch are larger than its texts
        for t in texts:
            data += shingle_set(t.as_py(), words).tobytes()
            ends.append(len(data))
        places = pa.py_buffer(np.array(ends, np.int64))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, places, pa.py_buffer(data)])

    full.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(full, "binary")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach ``percent`` of their union in common."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(percent: int):
    def confirm(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = ((np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")) for a, b in zip(left, right))
        found = [_alike(a, b, percent) for a, b in pairs]
        return pa.array(found, pa.bool_())

    confirm.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(confirm, "boolean")


class Groups:
    """Which of a group's members are known to be in one component."""

    def __init__(self, names: list):
        places: dict = {}
        self.up = [places.setdefault(name, i) for i, name in enumerate(names)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _compare(percent: int, n_bands: int, rows: int):
    least = percent / 100 - SIGMAS * math.sqrt(percent / 100 * (1 - percent / 100) / SIZE)

    def compare(group: pa.Table) -> pa.Table:
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        band, block = group["band"][0].as_py(), group["block"].to_numpy()
        reps, sets = group["rep"].to_pylist(), [np.frombuffer(s, "<u8") for s in group["set"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        drawn = np.stack([np.frombuffer(s, "<u4") for s in group["sketch"].to_pylist()])
        together, found = Groups(group["component"].to_pylist()), []
        known = np.array(together.up)
        for i in range(len(reps)):
            others = i + 1 + np.flatnonzero(known[i + 1 :] != known[i])
            if lo != hi:
                others = others[block[others] != block[i]]
            others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
            if not len(others):
                continue
            same = drawn[others] == drawn[i]
            share = same.mean(axis=1)
            whole = same[:, : n_bands * rows].reshape(len(others), n_bands, rows).all(axis=2)
            likely = (share >= least) & (whole.argmax(axis=1) == band)
            for j in others[likely][np.argsort(-share[likely], kind="stable")].tolist():
                x, y = together.root(i), together.root(j)
                if x != y and _alike(sets[i], sets[j], percent):
                    together.up[max(x, y)] = min(x, y)
                    found.append((reps[i], reps[j]))
        kind = group.schema.field("rep").type
        return pa.table({"a": pa.array([a for a, _ in found], kind), "b": pa.array([b for _, b in found], kind)})

    return compare


def near_links(docs: DataFrame, classes: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Components of classes that links between different sets join: (node, component)."""
    n_bands, rows = bands(percent)
    part = F.expr(f"substring(sketch, {4 * rows} * band + 1, {4 * rows})")
    numbers = F.sequence(F.lit(0), F.lit(n_bands - 1))
    banded = classes.select("rep", "sketch", F.explode(numbers).alias("band"))
    banded = banded.select("rep", "band", F.xxhash64("band", part).alias("bucket"))
    crowded = banded.groupBy("band", "bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = stored(banded.join(crowded, ["band", "bucket"]), "members")

    column = F.col(f"`{text}`").cast("binary")
    wanted = members.select("rep").distinct()
    source = docs.select(F.col(f"`{key}`").alias("rep"), column.alias("text")).join(wanted, "rep", "left_semi")
    sets = stored(source.select("rep", _full_set(words)("text").alias("set")), "sets")

    edges = members.where("rep != leader").select("rep", "leader").distinct()
    leaders = sets.select(F.col("rep").alias("leader"), F.col("set").alias("other"))
    pairs = edges.join(sets, "rep").join(leaders, "leader")
    confirmed = pairs.where(_confirm(percent)("set", "other")).select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    stars = components(confirmed)

    named = members.where("n > 2").join(stars.withColumnRenamed("node", "rep"), "rep", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "rep")), "named")
    split = named.groupBy("band", "bucket").agg(F.min("component").alias("c"), F.max("component").alias("d"))
    open_rows = named.join(split.where("c != d").select("band", "bucket"), ["band", "bucket"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = open_rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with"))
    full = dealt.join(sets, "rep").join(classes.select("rep", "sketch"), "rep")
    full = full.select("band", "bucket", "lo", "hi", "block", "rep", "component", "set", "sketch")
    kind = dict(classes.dtypes)["rep"]
    more = full.groupBy("band", "bucket", "lo", "hi").applyInArrow(_compare(percent, n_bands, rows), f"a {kind}, b {kind}")
    known = stars.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.union(more))


def near_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_shingles``, ``component_id`` and ``kept``.

    Words are runs of characters other than white space in ASCII, with A-Z in
    lower case. A text with fewer words than a shingle is one shingle; one
    without words (or null) has none and is linked with nothing. Documents are
    linked if 100 * intersection >= ``percent`` * union of their sets. Rows
    with one key count as one document, and all of them stay if it does. Rows
    without a key are linked with nothing: they stay and have no component.
    Other columns are left out, whatever their names. Intermediate tables go to
    the shared folder; jobs run while the result is being built.
    """
    importable(docs.sparkSession)
    profile = _profile(words)(F.col(f"`{text}`").cast("binary"))
    profiled = docs.select(F.col(f"`{key}`").alias("id"), profile.alias("p"))
    found = stored(profiled.select("id", "p.n", "p.digest", "p.sketch"), "sketches")
    usable = found.where("n > 0 AND id IS NOT NULL")
    classes = stored(usable.groupBy("digest", "sketch").agg(F.min("id").alias("rep")), "classes")
    linked = near_links(docs, classes, key, text, words, percent)
    named = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("component"))
    joined = found.select("id", "n", "digest").join(named, "digest", "left")
    component: Column = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


#: For three words and 85 percent; a document without shingles is a component of its own.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1),
                        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles
  FROM t),
s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM l),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM l UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON b.x = r.other)
SELECT l.doc_id, len(shingles) AS n_shingles, min(other) AS component_id, min(other) = l.doc_id AS kept
FROM l JOIN reached r ON r.doc_id = l.doc_id GROUP BY l.doc_id, shingles
"""
