"""License notices in texts, by patience alignment with templates.

A template matches a place in a text if enough of its words are found there in
order. Words that occur once in the template and once in the place are anchors;
the longest run of anchors that rise in both splits the alignment, and the gaps
between them are aligned in the same way, after equal words at their ends.

A match that covers a share c of n words contains one of any
floor((1 - c) n) + 1 of them. The longest are taken as seeds, and only places
around seeds are aligned; no text without a seed can match. A place starts at a
word of the template and is aligned alone, as copies side by side leave no word
that occurs once. Texts are read once and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.workers import importable

COVERAGE = 0.8
SLACK = 1.5  # a match takes at most so many times the template's words
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")

# Public license notices.
TEMPLATES = {
    "Apache-2.0 mention": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "MIT mention": "Released under the MIT License",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "GPL-3.0 mention": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "CC-BY-NC-4.0 mention": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


class Template(NamedTuple):
    name: str
    words: list[bytes]
    seeds: frozenset[bytes]


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


def prepared(templates: dict[str, str], coverage: float) -> list[Template]:
    out = []
    for name, text in templates.items():
        words = words_of(text.encode())
        number = int((1 - coverage) * len(words) + 1e-9) + 1
        counts = Counter(words)
        seeds: list[bytes] = []
        held = 0
        for word in sorted(counts, key=lambda w: (-len(w), w)):
            if held >= number:
                break
            seeds.append(word)
            held += counts[word]
        out.append(Template(name, words, frozenset(seeds)))
    return out


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, sorted by their second number, whose first numbers rise."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (x, _) in enumerate(pairs):
        pile = bisect_left(tops, x)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[pile], piles[pile] = x, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places (in the text, in the template), rising in both."""
    found: list[tuple[int, int]] = []
    open_gaps = [(0, len(text), 0, len(template))]
    while open_gaps:
        a, b, c, d = open_gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1 and there[w] == 1}
        anchors = rising([(place[w], j) for j, w in enumerate(template[c:d], c) if w in place])
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        open_gaps += [(x + 1, p, y + 1, q) for (x, y), (p, q) in zip(edges, edges[1:])]
    return sorted(found)


def spans(hits: list[int], reach: int, text: int) -> Iterator[tuple[int, int]]:
    """Parts of the text that any match holding one of the ``hits`` lies in."""
    first = end = -1
    for hit in hits:
        if hit - reach <= end:
            end = hit + reach
        else:
            if end >= 0:
                yield max(0, first), min(text, end)
            first, end = hit - reach, hit + reach
    if end >= 0:
        yield max(0, first), min(text, end)


class Place(NamedTuple):
    covered: int  # words of the template
    start: int
    stop: int


def place_at(words: list[bytes], first: int, end: int, template: list[bytes], least: float) -> Place | None:
    """The match in a part of the text that is no longer than one."""
    part = words[first:end]
    if (Counter(part) & Counter(template)).total() < least:
        return None
    pairs = patience(part, template)
    if len(pairs) < least:
        return None
    return Place(len(pairs), first + pairs[0][0], first + pairs[-1][0] + 1)


def places(words: list[bytes], template: list[bytes], seeds: frozenset[bytes], least: float) -> Iterator[Place]:
    """Matches of a template by their first words; they may lie over each other."""
    n = len(template)
    reach, wanted = int(SLACK * n) + 1, frozenset(template)
    hits = [i for i, w in enumerate(words) if w in seeds]
    for first, end in spans(hits, reach, len(words)):
        starts = [i for i in range(first, end) if words[i] in wanted]
        at, far, seed = 0, 0, bisect_left(hits, first)
        while at < len(starts):
            start = starts[at]
            while seed < len(hits) and hits[seed] < start:
                seed += 1
            while far < len(starts) and starts[far] < start + reach:
                far += 1
            at += 1
            if seed == len(hits) or hits[seed] >= start + reach or far - at + 1 < least:
                continue
            covered = 0
            for size in (n, reach):  # as long as the template; then what has words in between
                place = place_at(words, start, min(end, start + size), template, least) if covered < n else None
                if place and place.covered > covered:
                    yield place
                    covered = place.covered
                    if covered == place.stop - place.start == n:
                        at = bisect_left(starts, place.stop)


def matches(text: bytes, templates: list[Template], coverage: float) -> list[dict]:
    """The best place of each template that matches, and how many places do."""
    lower = text.lower()
    likely = [t for t in templates if any(s in lower for s in t.seeds)]
    if not likely:
        return []
    words = WORD.findall(lower)
    out = []
    for name, wanted, seeds in likely:
        found = list(places(words, wanted, seeds, coverage * len(wanted)))
        best, last, number = None, -1, 0
        for place in sorted(found, key=lambda p: (p.stop, -p.start)):
            if place.start >= last:
                last, number = place.stop, number + 1
        for place in found:
            if best is None or (place.covered, place.start - place.stop) > (best.covered, best.start - best.stop):
                best = place
        if best:
            share = best.covered / len(wanted)
            out.append({"license": name, "coverage": share, "first_word": best.start, "end_word": best.stop, "n_places": number})
    return out


@lru_cache(maxsize=4)
def _ready(templates: tuple[tuple[str, str], ...], coverage: float) -> list[Template]:
    return prepared(dict(templates), coverage)


def found(text: Column, templates: dict[str, str], coverage: float) -> Column:
    fields = [("license", pa.string()), ("coverage", pa.float64())]
    fields += [(name, pa.int64()) for name in ("first_word", "end_word", "n_places")]
    kind, given = pa.list_(pa.struct(fields)), tuple(templates.items())

    def scan(texts: pa.Array) -> pa.Array:
        ready = _ready(given, coverage)
        return pa.array([matches(t.as_py() or b"", ready, coverage) for t in texts], kind)

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    shape = "array<struct<license:string,coverage:double,first_word:bigint,end_word:bigint,n_places:bigint>>"
    return F.arrow_udf(scan, shape)(text.cast("binary"))


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] = TEMPLATES,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per row of ``docs`` and template found in it.

    Columns: the key, ``license``, ``coverage`` (share of the template's words),
    ``first_word`` and ``end_word`` of the best place, the first of equal ones,
    and ``n_places``. Null and empty texts hold none; repeated rows are reported
    again. Other columns are left out, whatever their names.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.explode(found(F.col(f"`{text}`"), templates, coverage)).alias("m"))
    return rows.select(F.col("id").alias(key), "m.*")
