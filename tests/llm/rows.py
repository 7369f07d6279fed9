"""Small tables with every odd case, and plain versions of what operators compute."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ENGLISH = "the cat sat on the mat and then it went to the house of the old man by the river"
GERMAN = "der hund und die katze sind in dem haus und nicht auf der wiese bei dem alten mann am fluss"

#: Nulls, empty and white texts, ties, repeated rows, a long text, one without white space.
ODD = [
    (1, ENGLISH, "en"),
    (2, ENGLISH, "en"),
    (2, ENGLISH, "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n\x0b\x0c\r ", "de"),
    (None, GERMAN, "de"),
    (6, GERMAN, None),
    (7, GERMAN.replace(" ", "  "), "de"),
    (8, "x" * 70_000, "en"),
    (9, (ENGLISH + "\n") * 2_000, "en"),
    (10, "é日本語 😀    <|endoftext|> '''s 123", "xx"),
    (11, "one", "en"),
    (12, "### $$$ 123", "en"),
    (None, None, None),
]
#: Columns whose names clash with those that operators use or return.
CLASHING = ("kept", "length", "n_tokens", "component_id", "row", "p", "sequence_id", "lang_pred", "host", "ids", "d", "k")


def odd_table(spark, rows=ODD):
    fields = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*row, *["?"] * len(CLASHING)) for row in rows], fields).repartition(3)


def documents(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


def shingles(text, words):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    width = min(words, len(found))
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1)) if found else frozenset()


def near_components(texts: dict, words: int, percent: int) -> dict:
    """{key: (set size, smallest key reachable)} by comparing all pairs."""
    sets = {k: shingles(t, words) for k, t in texts.items()}
    up = {k: k for k in texts}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(k for k in texts if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small < percent * large:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (small + large - common):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(sets[k]), root(k)) for k in texts}


def base_counts(text):
    """words, word_chars, symbols, duplicate lines, words in repeated windows."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, places = Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            places.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(places)


def by_sequence(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    return found
