"""Source divergence, toxicity and resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import compare
from lanewise.llm import importance_resampling as resampling
from lanewise.llm import radix_sort, source_divergence, tables, toxicity
from rows import FOLDER, ODD, documents, odd_table

SOURCES = ["a", "b", None, ""]


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


# Source divergence


def test_divergence_matches_sql(spark, duck):
    found = tables.op11_source_divergence(spark, FOLDER)
    assert compare.differences(found, duck, source_divergence.ORACLE_SQL, some=True) == []


def odd_sources(spark):
    """Many sources, some without terms; long terms that share beginnings; nulls and repeated rows."""
    rng = random.Random(5)
    words = ["the", "THE", "x" * 40, "x" * 41, "x" * 39 + "y", "é", "日本語" * 9, "abcd", "abcde", "abc"]
    rows = []
    for i in range(700):
        text = rng.choice([None, "", "1 2 3", *[" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(9)]])
        rows.append((i // 2, text, rng.choice(["en", "de", None, ""]), rng.choice([*SOURCES, *map(str, range(9))])))
    rows += [(None, "rare", "xx", "only"), (None, "rare", "xx", "other"), *rows[:40]]
    fields = "doc_id long, text string, lang string, source string, part string, term string, value string, p string, number string"
    return spark.createDataFrame([(*r, *"?????") for r in rows], fields).repartition(5)


@pytest.mark.parametrize(("tile", "block"), [(128, 4096), (2, 3)])
def test_divergence_of_odd_rows(spark, monkeypatch, tile, block):
    monkeypatch.setattr(source_divergence, "SOURCE_TILE", tile)
    monkeypatch.setattr(source_divergence, "TERM_BLOCK", block)
    docs = odd_sources(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert compare.differences(source_divergence.divergence(docs), con, source_divergence.ORACLE_SQL, some=True) == []


def test_prefixes_below_the_threshold_are_not_extended(spark):
    docs = odd_sources(spark).selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "cast(coalesce(text, '') AS binary) AS text")
    long_terms = docs.sparkSession.createDataFrame([("en", "s", b"abcdefgh" + bytes([97 + i]) * 9) for i in range(40)], docs.schema)
    first = source_divergence._level(docs.unionByName(long_terms), 4, 0, None)
    kept = first.groupBy("lang", "prefix", "complete").sum("docs").where("`sum(docs)` >= 30 AND NOT complete")
    bits = source_divergence._filter(kept.select("lang", "prefix"))
    second = {(r.lang, bytes(r.prefix)) for r in source_divergence._level(docs.unionByName(long_terms), 8, 4, bits).collect()}
    assert ("en", b"abcdefgh") in second and all(p[:4] in (b"abcd", b"xxxx", "日本".encode()[:4]) for _, p in second)
    assert not any(lang == "xx" for lang, _ in second)


def test_a_level_only_looks_up_words_longer_than_the_one_before(monkeypatch):
    """Of three words one is longer than four bytes, and only its beginning meets the filter; texts without any are no trouble."""
    looked_up, original = [], source_divergence.hashed
    monkeypatch.setattr(source_divergence, "hashed", lambda texts: looked_up.extend(texts) or original(texts))
    partial = source_divergence.Partial(8, 4, np.full(source_divergence.FILTER_BITS // 8, 255, np.uint8))
    partial.add(["en", "en"], ["a", "a"], [b"one four lengthened, lengthened", b"one"])
    partial.add(["en"], ["b"], [b"one four"])
    (rows,) = (batch.to_pylist() for batch in partial.rows())
    assert rows == [{"lang": "en", "source": "a", "prefix": b"lengthen", "complete": False, "docs": 1, "times": 2}]
    assert [t for t in looked_up if t != b"en"] == [b"leng"]


def test_empty_tables(spark):
    empty = odd_sources(spark).limit(0)
    assert source_divergence.divergence(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int, score string")
    assert toxicity.toxicity(empty, labels).count() == 0
    target = spark.createDataFrame([], "item_id string, text string")
    assert resampling.resample(empty, target).count() == 0


# Toxicity


def brute_segments(scores):
    """The best segment, and what is left and right of it in the same way."""

    def inside(first, end):
        best = max(((sum(scores[a:b]), a, b) for a in range(first, end) for b in range(a + 1, end + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        _, a, b = best
        return [*inside(first, a), (a, b), *inside(b, end)]

    return inside(0, len(scores))


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(400):
        scores = [rng.uniform(-2, 1.6) for _ in range(rng.randint(0, 25))]
        found = toxicity.maximal_segments(scores)
        assert [(a, b) for a, b, _ in found] == brute_segments(scores)
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in found)


def test_segments_take_linear_time():
    scores = [1.0, -0.9] * 300_000 + [-1.0, 0.5] * 300_000
    assert len(toxicity.maximal_segments(scores)) == 300_001


def model_of(**scores):
    keys = toxicity.token_keys([k.encode() for k in scores])
    order = np.argsort(keys)
    return toxicity.Model(keys[order], np.array(list(scores.values()), float)[order], -0.5, rate=1.0, size=0.1)


def test_segments_of_runs():
    model = model_of(bad=4, worse=6, good=-3)
    rng = random.Random(4)
    for _ in range(100):
        words = rng.choices([b"bad", b"worse", b"good", b"other", b"any"], weights=[1, 1, 1, 5, 5], k=rng.randint(0, 30))
        # Distinct numbers, so that no two segments are equal.
        value = {b"bad": 4, b"worse": 6, b"good": -3}
        found = toxicity.segments(words, model)
        assert all(s.score == sum(value.get(w, -0.5) for w in words[s.first : s.end]) for s in found)
        plain = toxicity.maximal_segments([value.get(w, -0.5) for w in words])
        assert [s.score for s in found] == [s for _, _, s in plain]


def test_planted_toxic_words_are_found(spark):
    """Held-out documents: toxic ones hold words, or beginnings of words, that no clean one has."""
    rng = random.Random(9)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    rows, labels = [], []
    for i in range(1500):
        toxic = int(i % 5 == 0)
        words = rng.choices(plain, k=rng.randint(20, 300))
        if toxic:
            at = rng.randint(0, len(words))
            words[at:at] = [rng.choice(["vile", "zork" + rng.choice(plain)]) for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic if i % 50 else 1 - toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    held = [r for r in found.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.values())
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.98 * len(held)
    texts = dict(rows)
    for r in held:
        if r.predicted and r.doc_id % 5 == 0:
            words = texts[r.doc_id].split()
            assert any("vile" in words[p.first : p.end] or any(w.startswith("zork") for w in words[p.first : p.end]) for p in r.passages)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = toxicity.fold(labels["doc_id"]) == toxicity.HELD_OUT
    other = labels.withColumn("toxic", 1 - labels["toxic"]).where(held).unionByName(labels.where(~held))
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).drop("passages").collect())) for x in (labels, other))
    assert a == b and len(a) == docs.count()


def test_toxicity_of_odd_rows(spark):
    docs = odd_table(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, None), (None, 1), (7, 5)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(k for k, *_ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_key = {r.doc_id: r.score for r in found}
    assert by_key[3] == by_key[4] == by_key[5] and by_key[1] == by_key[2]
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


# Resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, percent=5, least=20):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10_000

    known = [(k, *features(t)) for k, t in rows]
    s = Counter(bucket(f) for _, _, fs in known for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for key, n, fs in known:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    ranks = {}
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        ranks.setdefault(r, []).append(i + 1)
    return sorted(((k, n, w, x, (ranks.get((k, m, n, w, x)) or [None]).pop(0)) for k, m, n, w, x in out), key=str)


def test_resampling_matches_brute_force(spark):
    docs = documents(spark)
    target = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = tables.op13_importance_resampling(spark, FOLDER)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    expected = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sorted(map(tuple, found.collect()), key=str) == expected


def test_resampling_of_odd_rows(spark):
    docs = odd_table(spark)
    target = spark.createDataFrame([(1, "the old man"), (2, None), (3, "")], "item_id long, text string")
    for percent, least in ((50, 20), (100, 0)):
        found = resampling.resample(docs, target, percent=percent, least_words=least).collect()
        expected = brute_resample([(k, t) for k, t, _ in ODD], ["the old man"], percent, least)
        assert sorted(map(tuple, found), key=str) == expected


def test_feature_checksums():
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abc\xff", k=rng.choice([1, 2, 7, 63, 64, 65, 300]))) for _ in range(200)]
    buckets, places = resampling.feature_buckets(words)
    expected = {(i, zlib.crc32(b" ".join(words[i : i + k])) % 10_000) for k in (1, 2, 3) for i in range(len(words) - k + 1)}
    assert len(buckets) == 3 * len(words) - 3 and set(zip(places.tolist(), buckets.tolist())) == expected
    assert len(resampling.feature_buckets([])[0]) == 0 and len(resampling.feature_buckets([b"one"])[0]) == 1


@pytest.mark.parametrize(("bits", "block"), [(11, 1 << 16), (3, 7), (1, 1000)])
def test_radix_sort(spark, bits, block):
    rng = random.Random(2)
    rows = [(rng.choice([None, 0, -5, 3, 17]), rng.choice([None, 1, 2**40 if bits > 1 else 9, -7]), i) for i in range(60)]
    rows += [(1, 1, 0)] * 70
    table = spark.createDataFrame(rows, "a long, b long, i long").repartition(3)
    found = sorted(map(tuple, radix_sort.ranked(table, ["a", "b"], bits, block).select("place", "a", "b", "i").collect()))
    expected = sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))
    assert [r[0] for r in found] == list(range(len(rows)))
    assert [r[1:] for r in found] == expected
