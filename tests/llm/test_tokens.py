import random
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from rows import ODD, by_sequence, documents, odd_table
from tokenizers import Tokenizer

from lanewise.llm import packing, token_counts, transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"aabcdefghijklmnopqrstuvwxyzABCΣσİıéèßüñ'''0123.,;!?-_$%&|<> \t\n\x0b\x85\xa0　日本語한글😀²½", "é", "the", "ing"]
PARTS += ["<|endoftext|>", "<|startoftext|>", "'re", "'ll", "aaaa", "ﬁ", "\x1c", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 60))) for _ in range(n)]


def test_transducer_gives_the_library_ids(library):
    machine = transducer.Transducer(PATH)
    names = [t.replace("</w>", "") for t in library.get_vocab()]
    pick = random.Random(2)
    texts = random_texts(1500, 1) + ["".join(pick.sample(names, 3)) for _ in range(1500)]
    for text in texts:
        ids = b"".join(map(machine.word, text.encode().split()))
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_states_are_made_anew(library, monkeypatch):
    monkeypatch.setattr(transducer, "MOST_STATES", 50)
    machine = transducer.Transducer(PATH)
    text = "internationalization of unbelievable counterrevolutionaries"
    ids = b"".join(machine.word(w.encode()) for w in text.split())
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_chunk_maps_compose(library, chunk):
    word = transducer.counts(PATH).__getitem__
    for text in random_texts(60, chunk):
        data = text.encode()
        scan = token_counts.Scan(data, word, chunk)
        assert scan.total() == len(library.encode(text, add_special_tokens=False).ids)
        for end, n in zip(range(chunk, len(data), chunk), scan.at_chunk_ends()):
            head = data[:end].decode("utf-8", "ignore")
            if head.encode() == data[:end]:
                assert n == len(library.encode(head, add_special_tokens=False).ids)


def test_odd_rows(spark, library):
    got = Counter(tuple(r) for r in token_counts.token_counts(odd_table(spark), PATH, limit=20).collect())
    want = Counter()
    for key, text, _ in ODD:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[(key, len((text or "").encode()), n, n > 20)] += 1
    assert got == want
    assert token_counts.token_counts(odd_table(spark).limit(0), PATH).count() == 0


def smallest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            j = bins.index(room)
            bins[j] -= items[i]
            go(i + 1, bins)
            bins[j] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_tables():
    pick = random.Random(3)
    for _ in range(150):
        capacity = pick.choice([10, 20, 30])
        items = [pick.randint(1, capacity) for _ in range(pick.randint(1, 10))]
        counts = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        patterns, used = packing.bin_completion(counts), np.zeros_like(counts)
        for p in patterns:
            assert sum(s * k for s, k in p.items) <= capacity
            for s, k in p.items:
                used[s] += p.times * k
        assert (used == counts).all()
        best = smallest(items, capacity)
        assert packing.lower_bound(counts) <= best == sum(p.times for p in patterns)


def fewest(items, capacity, visits=60_000):
    """As ``smallest`` for more items, by what is left in open bins; null if that takes too long."""
    items, best, seen = sorted(items, reverse=True), [len(items)], set()
    after = np.cumsum(items[::-1])[::-1].tolist() + [0]

    def go(i, rooms):
        if i == len(items):
            best[0] = min(best[0], len(rooms))
        needed = len(rooms) + max(0, -(-(after[i] - sum(rooms)) // capacity))
        if i == len(items) or needed >= best[0] or (i, rooms) in seen or len(seen) > visits:
            return
        seen.add((i, rooms))
        for room in sorted({r for r in rooms if r >= items[i]}):
            rest = list(rooms)
            rest.remove(room)
            go(i + 1, tuple(sorted([*rest, room - items[i]])))
        go(i + 1, tuple(sorted([*rooms, capacity - items[i]])))

    go(0, ())
    return best[0] if len(seen) <= visits else None


def test_bin_completion_is_optimal_on_larger_tables():
    pick, compared = random.Random(5), 0
    for _ in range(500):
        low, high = pick.choice([5, 10, 18, 20, 26]), pick.choice([45, 51, 60, 70])
        items = [pick.randint(low, high) for _ in range(pick.randint(15, 24))]
        counts = np.bincount(items, minlength=101).astype(np.int64)
        number = sum(p.times for p in packing.bin_completion(counts))
        if number > packing.lower_bound(counts):
            best = fewest(items, 100)
            assert best is None or number == best, items
            compared += best is not None
    assert compared > 20


def test_fillings_are_all_that_nothing_dominates():
    pick = random.Random(9)
    for _ in range(60):
        room, counts = pick.randint(5, 16), np.zeros(17, np.int64)
        for _ in range(pick.randint(1, 7)):
            counts[pick.randint(1, 9)] += 1
        sizes = [s for s in range(1, room + 1) if counts[s]]
        sets = {tuple((s, k) for s, k in zip(sizes[::-1], ks[::-1]) if k) for ks in product(*[range(int(counts[s]) + 1) for s in sizes])}
        sets = {found for found in sets if sum(s * k for s, k in found) <= room}
        got = [found for found in packing.fillings(counts, room, room) if found is not None]
        assert len(got) == len(set(got)) and set(got) <= sets
        # Every set is, or fits into, one that is given.
        assert all(any(packing._fits_into(found, g) for g in got) for found in sets)


def test_bin_completion_reaches_the_bound_on_many_pieces():
    sizes = np.clip(np.random.default_rng(1).lognormal(6.3, 1.0, 50_000).astype(int), 1, 2048)
    counts = np.bincount(sizes, minlength=2049).astype(np.int64)
    number = sum(p.times for p in packing.bin_completion(counts))
    assert number == packing.lower_bound(counts) <= sum(p.times for p in packing.best_fit(counts))


def check_packing(rows, texts, library, capacity):
    for inside in by_sequence(rows).values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for key, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            want[(key, i // capacity, i, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_sequence(rows))


def test_packing_of_odd_rows(spark, library):
    rows = packing.pack(odd_table(spark), PATH, capacity=64).collect()
    check_packing(rows, [(k, t) for k, t, _ in ODD], library, 64)
    assert packing.pack(odd_table(spark).limit(0), PATH).count() == 0


def test_packing_of_documents(spark, library):
    docs = documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.pack(docs, PATH).collect()
    assert check_packing(rows, texts, library, 2048) == -(-sum(r.length for r in rows) // 2048)


def test_every_code_point_equals_the_library(library):
    """Alone and inside a word; letter case and classes are those of the library's Unicode tables."""
    machine = transducer.Transducer(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    for first in range(0, len(points), 5000):
        texts = [t for c in points[first : first + 5000] for t in (chr(c), f"a{chr(c)}b")]
        for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            ids = b"".join(map(machine.word, text.encode().split()))
            assert np.frombuffer(ids, "<u4").tolist() == known.ids, hex(ord(text[-1]))


@pytest.mark.parametrize(
    ("kind", "seconds"),
    [("chinese", 20), ("special", 10), ("letters", 30), ("signs", 10)],
)
def test_two_megabytes_without_white_space(library, kind, seconds):
    pick = random.Random(3)
    text = {
        "chinese": lambda: "".join(chr(pick.randrange(0x4E00, 0x9000)) for _ in range(700_000)),
        "special": lambda: "<|endoftext|>x" * 140_000,
        "letters": lambda: "abcdefghij" * 200_000,
        "signs": lambda: "=-" * 1_000_000,
    }[kind]()
    word = transducer.Transducer(PATH).word
    start = time.perf_counter()
    ids = word(text.encode())
    assert time.perf_counter() - start < seconds
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
