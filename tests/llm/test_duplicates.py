import random
from collections import Counter

import compare
import numpy as np
import pytest
from rows import FOLDER, ODD, WORD, documents, near_components, odd_table

from lanewise.llm import exact_dedup, near_dedup
from lanewise.llm.components import components


def plain_exact(rows):
    groups = {}
    for i, (key, text, _) in enumerate(rows):
        groups.setdefault("".join(WORD.findall(text or "")), []).append((-len(text or ""), key is None, key or 0, i, key))
    out = Counter()
    for members in groups.values():
        best = min(m[:3] for m in members)
        keep = next(m[4] for m in members if m[:3] == best)
        first = True
        for m in sorted(members, key=lambda m: m[:4]):
            kept = m[:3] == best and first
            first = first and not kept
            out[(m[4], keep, len(members), kept)] += 1
    return out


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates_of_odd_rows(spark, bits):
    rows = [*ODD, (20, "a b", "x"), (21, "ab", "x"), (22, "a  b", "x"), (23, "ab ", "x"), (24, "ba", "x")]
    got = exact_dedup.exact_dedup(odd_table(spark, rows), bits=bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == plain_exact(rows)
    assert exact_dedup.exact_dedup(odd_table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("bits", [64, 6])
def test_exact_duplicates_of_documents(spark, bits):
    found = exact_dedup.exact_dedup(documents(spark), bits=bits).drop("raw_hash")
    assert compare.differences(found, compare.connect(FOLDER), exact_dedup.ORACLE_SQL) == []


def test_chunks_join_to_the_text_and_follow_insertions(spark):
    pick = random.Random(1)
    text = "".join(pick.choice("abcdeé日\n") for _ in range(30_000))
    rows = spark.createDataFrame([(text,), ("xyz" + text,), ("",), ("a" * 9_000,)], "t string")
    cut = [r.c for r in rows.select(exact_dedup.chunks(rows["t"]).alias("c")).collect()]
    assert ["".join(c) for c in cut] == [text, "xyz" + text, "", "a" * 9_000]
    assert len(set(cut[0]) & set(cut[1])) >= len(cut[0]) - 2 and max(map(len, cut[3])) <= exact_dedup.LONGEST


def test_components(spark):
    pick = random.Random(4)
    links = [(pick.randint(0, 400), pick.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)]
    up = {x: x for pair in links for x in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_coordinate_is_filled_and_agrees_like_the_similarity():
    rng = np.random.default_rng(5)
    for size in (1, 3, 20, 500, 5_000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.concatenate([a[: int(size * 0.9)], rng.integers(0, 1 << 63, size - int(size * 0.9)).astype(np.uint64)])
        rows = near_dedup.sketches([a, a[::-1].copy(), np.unique(b), np.empty(0, np.uint64)])
        assert (rows[0] == rows[1]).all() and not (rows[0] == rows[3]).any()
        similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((rows[0] == rows[2]).mean() - similar) < 0.2


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_bands_miss_almost_nothing(percent):
    bands, rows = near_dedup.bands(percent)
    assert bands * rows <= near_dedup.SIZE and (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISSED


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_documents(spark, words, percent):
    docs = documents(spark)
    want = near_components({r.doc_id: r.text for r in docs.collect()}, words, percent)
    got = near_dedup.near_dedup(docs, words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (n, c, k == c) for k, (n, c) in want.items()}


@pytest.mark.parametrize("block", [8, 1024])
def test_near_duplicates_in_one_large_group(spark, monkeypatch, block):
    """Copies with random edits: similarities on both sides of the limit, chains, and no equal sets."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    pick = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for key in range(150):
        words = list(base)
        for _ in range(pick.randint(0, 5)):
            words[pick.randrange(80)] = f"e{key}x{pick.randrange(1000)}"
        texts[key] = " ".join(words)
    texts |= {200 + i: texts[i].upper() for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = near_components(texts, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs, words=3, percent=85).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    got = Counter(tuple(r) for r in near_dedup.near_dedup(odd_table(spark), words=3, percent=85).collect())
    want = near_components({k: t for k, t, _ in ODD if k is not None}, 3, 85)
    sizes = near_components({i: t for i, (_, t, _) in enumerate(ODD)}, 3, 101)
    expected = Counter()
    for i, (key, _, _) in enumerate(ODD):
        row = (None, sizes[i][0], None, True) if key is None else (key, *want[key], want[key][1] == key)
        expected[row] += 1
    assert got == expected
    assert near_dedup.near_dedup(odd_table(spark).limit(0)).count() == 0
