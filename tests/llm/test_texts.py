import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from rows import ENGLISH, FOLDER, GERMAN, ODD, base_counts, documents, odd_table

from lanewise.llm import language_id, licenses, piece_codec, quality_rules

LARGER = FOLDER.replace("sf0.001", "sf0.01")


def test_held_out_languages(spark):
    docs = documents(spark, LARGER)
    found = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert len(found) > 100 and right >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 and abs(sum(s.share for s in r.shares) - 1) < 1e-6 for r in found)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(random.Random(i).sample(t.split(), 12)), n) for i in range(80) for t, n in ((ENGLISH, "en"), (GERMAN, "de"))]
    return language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_mixtures(model):
    labeller = language_id.Labeller(model)
    texts = [ENGLISH, GERMAN, " ".join([ENGLISH] * 3 + [GERMAN]), "", "12 ###", "the"]
    rows = labeller.shares([t.encode() for t in texts])
    de, en = model.languages.index("de"), model.languages.index("en")
    assert rows[0][en] == 1 and rows[1][de] == 1 and rows[5][en] == 1
    share = 3 * len(ENGLISH.split()) / (3 * len(ENGLISH.split()) + len(GERMAN.split()))
    assert abs(rows[2][en] - share) < 0.1 and not rows[3].any() and not rows[4].any()
    again = np.concatenate([labeller.shares([t.encode()]) for t in texts])
    assert np.allclose(rows, again)
    labeller.forget()
    assert np.allclose(rows, labeller.shares([t.encode() for t in texts]))


def test_expectation_maximisation_finds_the_largest_likelihood():
    rng = np.random.default_rng(7)
    scores = rng.normal(size=(200, 2)) * 3
    share = language_id._maximised(np.exp(scores), np.zeros(200, int), np.array([0]), np.array([[0.5, 0.5]]))[0][0, 0]
    grid = np.linspace(0.001, 0.999, 999)
    values = [np.log(g * np.exp(scores[:, 0]) + (1 - g) * np.exp(scores[:, 1])).sum() for g in grid]
    assert abs(share - grid[int(np.argmax(values))]) < 0.02


def test_languages_of_odd_rows(spark):
    got = language_id.language_id(odd_table(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _, _ in ODD)
    label = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(label[k] == ("und", 0.0) for k in (3, 4, 5, 12)) and label[1][0] in ("en", "xx")
    assert language_id.language_id(odd_table(spark).limit(0)).count() == 0
    unlabelled = odd_table(spark, [(1, "some words", None)])
    assert [r.lang_pred for r in language_id.language_id(unlabelled).collect()] == ["und"]


def test_base_counts(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(k, t) for k, t, _ in ODD]
    for _, text in rows:
        counts = dict(zip(quality_rules.COUNTS, quality_rules.text_counts((text or "").encode(), len(text or ""))))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(counts[n] for n in names) == base_counts(text)


def test_rules_separate_the_labels(spark):
    docs, labels = documents(spark, LARGER.replace("sf0.01", "sf0.1")), spark.read.parquet(f"{LARGER.replace('sf0.01', 'sf0.1')}/labels.parquet")
    rules = quality_rules.rules_from(docs, labels)
    assert rules
    judged = quality_rules.quality_rules(docs, labels).where("NOT base_failed").join(labels, "doc_id").collect()
    bad, good = [r for r in judged if r.quality == 0], [r for r in judged if r.quality == 1]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad) and sum(not r.kept for r in good) <= 0.005 * len(good)


def test_learning_finds_a_planted_rule_and_its_expression_agrees(spark):
    rng = np.random.default_rng(8)
    values = rng.random((3_000, len(quality_rules.FEATURES)))
    bad = (values[:, 0] > 0.7) & (values[:, 3] <= 0.5)
    rules = quality_rules.learn(values, bad)
    covered = np.zeros(len(bad), bool)
    for rule in rules:
        covered |= quality_rules._covered(values, rule.conditions)
    assert (covered == bad).mean() > 0.98
    assert quality_rules.learn(values, np.zeros(3_000, bool)) == quality_rules.learn(values[:0], bad[:0]) == []


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = Counter((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.quality_rules(odd_table(spark), labels).collect())
    want = Counter()
    for key, text, _ in ODD:
        n, _, _, _, repeated = base_counts(text)
        failed = n < 10 or 100 * repeated > 20 * n
        want[(key, n, repeated, failed, not failed)] += 1
    assert got == want
    assert quality_rules.quality_rules(odd_table(spark).limit(0), labels.limit(0)).count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_patience_alignment():
    pick = random.Random(9)
    for _ in range(300):
        a = [bytes([pick.choice(b"abcdefghij")]) for _ in range(pick.randint(0, 14))]
        b = [bytes([pick.choice(b"abcdefghij")]) for _ in range(pick.randint(0, 14))]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= longest_common(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert licenses.patience(a, a) == [(i, i) for i in range(len(a))]


def test_planted_licenses_are_found():
    ready = licenses.prepared(licenses.TEMPLATES, licenses.COVERAGE)
    pick = random.Random(10)
    for template in ready:
        n = len(template.words)
        for changed in range(int((1 - licenses.COVERAGE) * n) // 2 + 1):
            words = list(template.words)
            for i in pick.sample(range(n), changed):
                words[i] = b"zz%d" % i
            text = b" ".join([b"lorem license"] * 40 + words + [b"the end"] * 500)
            hit = [m for m in licenses.matches(text, ready, licenses.COVERAGE) if m["license"] == template.name]
            assert hit and hit[0]["coverage"] >= (n - changed) / n - 0.05, template.name
            assert 80 - 3 <= hit[0]["first_word"] <= 80 + changed + 1
    assert licenses.matches(b"a license is under the version of a work", ready, licenses.COVERAGE) == []


def brute_places(words, template, least):
    """Most matches side by side, by the longest common subsequence of every part of the text."""
    reach, last, number = int(licenses.SLACK * len(template)) + 1, 0, 0
    for stop in range(len(words) + 1):
        if longest_common(words[max(last, stop - reach) : stop], template) >= least:
            last, number = stop, number + 1
    return number


def test_copies_side_by_side():
    ready = licenses.prepared({"mit": "Released under the MIT License", "long": licenses.TEMPLATES["ISC"]}, licenses.COVERAGE)
    line = b"Released under the MIT License. "
    assert [m["n_places"] for m in licenses.matches(line * 2, ready, licenses.COVERAGE)] == [2]
    assert [m["n_places"] for m in licenses.matches(line * 100, ready, licenses.COVERAGE)] == [100]
    got = licenses.matches(b"license under the license " + line * 3, ready, licenses.COVERAGE)[0]
    assert (got["coverage"], got["first_word"], got["end_word"], got["n_places"]) == (1, 4, 9, 3)
    pick = random.Random(12)
    for _ in range(150):
        template = pick.choice(ready)
        words = []
        for _ in range(pick.randint(1, 5)):
            copy = list(template.words)
            if pick.random() < 0.3:
                copy[pick.randrange(len(copy))] = b"zz"
            if pick.random() < 0.3:
                copy.insert(pick.randrange(1, len(copy)), b"zz")
            words += copy + pick.choices([b"license", b"under", b"xx", b"this"], k=pick.choice([0, 0, 1, 3]))
        least = licenses.COVERAGE * len(template.words)
        found = [m for m in licenses.matches(b" ".join(words), ready, licenses.COVERAGE) if m["license"] == template.name]
        assert found[0]["n_places"] == brute_places(words, template.words, least), words


def test_licenses_in_rows(spark):
    line = "Released under the MIT License."
    rows = [*ODD, (30, f"x\n{line}", "en"), (30, f"x\n{line}", "en"), (None, f"{line} {ENGLISH} {line}", "en")]
    got = Counter((r.doc_id, r.license, r.coverage, r.first_word, r.n_places) for r in licenses.scan_licenses(odd_table(spark, rows)).collect())
    assert got == Counter({(30, "MIT mention", 1.0, 1, 1): 2, (None, "MIT mention", 1.0, 0, 2): 1})
    assert licenses.scan_licenses(odd_table(spark).limit(0)).count() == 0
    docs = documents(spark, LARGER)
    marks = {"Apache-2.0 mention": "Licensed under the Apache License, Version 2.0", "MIT mention": "Released under the MIT License"}
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    for r in docs.collect():
        for name, mark in marks.items():
            assert ((r.doc_id, name) in found) == (mark in r.text)


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))


def best_score(codec, text):
    """Score of the best segmentation, over all of them."""
    pieces = {codec.written[i].decode().replace(" ", "▁"): codec.scores[i] for i in codec.ids}
    text = "▁" + text.replace(" ", "▁")
    best = [0.0]
    for end in range(1, len(text) + 1):
        ways = [best[end - 1] + codec.unknown]
        ways += [best[i] + pieces[text[i:end]] for i in range(max(0, end - 20), end) if text[i:end] in pieces]
        best.append(max(ways))
    return best[-1]


def test_segmentations_are_the_best_and_decode(codec):
    pick, letters = random.Random(11), {i: bytes([b]) for b, i in codec.bytes.items()}
    for _ in range(400):
        text = "".join(pick.choice("abcdefg hijk  the ing\n\téüß日本語😀ң梦.,!") for _ in range(pick.randint(1, 30)))
        ids = np.frombuffer(codec.encode([text.encode()])[0], '<u4').tolist()
        assert codec.decode(ids).decode() == text
        spelled = b"".join(letters[i] for i in ids if i in letters).decode()
        score = sum(codec.scores[i] for i in ids if i not in letters) + codec.unknown * len(spelled)
        assert abs(score - best_score(codec, text)) < 1e-6 * abs(score)


def test_trie_holds_its_keys():
    pick = random.Random(12)
    keys = list({bytes(pick.choices(range(256), k=pick.randint(1, 4))) for _ in range(3_000)})
    trie = piece_codec.Trie(keys)
    for number, key in enumerate(keys):
        found = trie.prefixes(key + b"zz", 0)
        assert (len(key), number) in found
        assert sorted(keys[i] for _, i in found) == sorted(k for k in {(key + b"zz")[:n] for n in range(1, 7)} if k in set(keys))


def test_codec_of_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = piece_codec.code_table(odd_table(spark), path).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _, _ in ODD) and all(r.round_trip for r in got)
    assert all(r.n_pieces == 0 for r in got if r.doc_id in (3, 4))
    rows = piece_codec.encode_table(odd_table(spark), path)
    texts = Counter(tuple(r) for r in piece_codec.decode_table(rows, path).collect())
    assert texts == Counter((k, t or "") for k, t, _ in ODD)
    strange = spark.createDataFrame([(1, None), (2, []), (3, [10**6, -1])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in piece_codec.decode_table(strange, path).collect()} == {(1, None), (2, ""), (3, "")}
    assert piece_codec.code_table(odd_table(spark).limit(0), path).count() == 0


def test_long_texts_without_white_space_are_searched_in_linear_time(codec):
    pick = random.Random(5)
    know = codec
    for text in ("".join(chr(pick.randrange(0x4E00, 0x9000)) for _ in range(700_000)), "abcdefgh" * 250_000):
        start = time.perf_counter()
        ids = know.encode([text.encode()])[0]
        assert time.perf_counter() - start < 20
        assert know.decode(np.frombuffer(ids, "<u4").tolist()).decode() == text
