"""Nearest entries of a list by edit distance: a trie whose branches share rows of the distance table.

Texts of one length walk the trie together, depth by depth, as arrays: a state is
a text, a node and the row of the distance table between the text and the
node's characters. A child's row follows from its parent's, so entries with a
common beginning share its rows. A state is given up when no entry below its
node can be near enough; a state without edits left only meets the children
that go on as the text does, which are looked up. The allowed distance grows from round to round until
the best entry found is better than anything farther away could be, so texts
with a near entry never meet the rest of the list.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

ORD_SPACE = 1 << 48
PREFIX_SCORE = 90
CELLS = 1 << 21  # of rows that are extended at once
CHAR_BITS = 21


def closeness(distance, longest):
    """``100 * (1 - distance / longest)`` rounded half up, for arrays; 0 for empty texts."""
    whole = np.maximum(longest, 1)
    return np.where(np.asarray(longest) > 0, ((whole - distance) * 200 + whole) // (2 * whole), 0)


def rank_of(score, ord_):
    """The smallest rank is the best match: by score, then by ``ord``."""
    return (100 - np.asarray(score, np.int64)) * ORD_SPACE + ord_


class Trie:
    """Nodes by depth, children of a node side by side; ``ord`` is the lowest of the entries that end in a node, or -1."""

    def __init__(self, entries: dict[str, int]):
        texts = sorted(entries)
        points = [np.array(list(map(ord, t)), np.int32) for t in texts]
        lengths = np.array([len(t) for t in texts], np.int64)
        depths = int(lengths.max(initial=0))
        ords = np.array([entries[t] for t in texts], np.int64)
        self.first = [np.zeros(1, np.int64)]  # by depth and node: its first child, and how many
        self.children: list[np.ndarray] = []
        self.char = [np.full(1, -1, np.int32)]
        self.edge = [np.zeros(1, np.int64)]  # by depth and node: its parent and character, ascending
        self.ord = [np.array([ords[0] if len(texts) and not lengths[0] else -1])]
        at = np.arange(len(texts))[lengths > 0]  # entries that reach the depth, sorted
        node = np.zeros(len(at), np.int64)
        shortest, longest = [np.array([lengths.min(initial=0)])], [np.array([depths])]
        for depth in range(1, depths + 1):
            char = np.array([points[i][depth - 1] for i in at.tolist()], np.int32)
            new = np.ones(len(at), bool)
            new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
            heads = new.nonzero()[0]
            counts = np.bincount(node[heads], minlength=len(self.char[-1]))
            self.children.append(counts)
            self.first[-1] = np.cumsum(counts) - counts
            self.char.append(char[heads])
            self.edge.append(node[heads] << CHAR_BITS | char[heads])
            self.first.append(np.zeros(len(heads), np.int64))
            # Of equal beginnings the shortest entry is sorted first, so it ends in the node if one does.
            ends = lengths[at[heads]] == depth
            self.ord.append(np.where(ends, ords[at[heads]], -1))
            shortest.append(np.minimum.reduceat(lengths[at], heads))
            longest.append(np.maximum.reduceat(lengths[at], heads))
            node = np.cumsum(new) - 1
            stay = lengths[at] > depth
            at, node = at[stay], node[stay]
        self.children.append(np.zeros(len(self.char[-1]), np.int64))
        self.edge.append(np.zeros(0, np.int64))
        self.shortest, self.longest, self.depths = shortest, longest, depths

    def step(self, depth: int, chars: np.ndarray, node: np.ndarray, rows: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children that states of one depth may go on to: the number of the state and the child.

        ``chars`` are the code points of each state's text. A row without edits
        left stays within ``most`` only where the child has the next character.
        """
        counts = self.children[depth][node]
        at_most = rows[:, :-1] == most[:, None]
        led = (rows.min(axis=1) == most) & (at_most.sum(axis=1) < counts)
        counts = np.where(led, 0, counts)
        parent = np.repeat(np.arange(len(node)), counts)
        child = self.first[depth][node][parent] + np.arange(len(parent)) - np.repeat(np.cumsum(counts) - counts, counts)
        if not led.any():
            return parent, child
        state, place = (at_most & led[:, None]).nonzero()
        pairs = np.unique(state << CHAR_BITS | chars[state, place])
        state, char = pairs >> CHAR_BITS, pairs & (1 << CHAR_BITS) - 1
        edge, known = node[state] << CHAR_BITS | char, self.edge[depth + 1]
        found = np.searchsorted(known, edge)
        there = known[np.minimum(found, len(known) - 1)] == edge
        return np.concatenate([parent, state[there]]), np.concatenate([child, found[there]])

    def search(self, texts: np.ndarray, most: np.ndarray, best: np.ndarray) -> None:
        """Lower the ranks in ``best`` by the entries that are at most ``most`` edits away from texts of one length.

        ``texts`` has a row of code points per text.
        """
        n, size = texts.shape
        place = np.arange(size + 1, dtype=np.int32)
        if self.ord[0][0] >= 0:
            np.minimum(best, np.where(size <= most, rank_of(closeness(size, size), self.ord[0][0]), best), out=best)
        waiting = [(0, np.arange(n), np.zeros(n, np.int64), np.broadcast_to(place, (n, size + 1)))]
        while waiting:
            depth, text, node, rows = waiting.pop()
            # As many states as may be extended at once; the others wait.
            room = np.cumsum(self.children[depth][node]) * (size + 1) <= CELLS
            now = max(int(room.sum()), 1)
            if now < len(text):
                waiting.append((depth, text[now:], node[now:], rows[now:]))
                text, node, rows = text[:now], node[:now], rows[:now]
            parent, child = self.step(depth, texts[text], node, rows, most[text])
            text, depth = text[parent], depth + 1
            if not len(text):
                continue
            # What no row can undercut: the lengths alone.
            fits = np.maximum(size - self.longest[depth][child], self.shortest[depth][child] - size) <= most[text]
            text, child, before = text[fits], child[fits], rows[parent[fits]]
            differs = texts[text] != self.char[depth][child][:, None]
            row = np.empty((len(text), size + 1), np.int32)
            row[:, 0] = depth
            row[:, 1:] = np.minimum(before[:, 1:] + 1, before[:, :-1] + differs)
            row = np.minimum.accumulate(row - place, axis=1) + place
            ended = (self.ord[depth][child] >= 0) & (row[:, -1] <= most[text])
            if ended.any():
                score = closeness(row[ended, -1].astype(np.int64), max(size, depth))
                np.minimum.at(best, text[ended], rank_of(score, self.ord[depth][child[ended]]))
            # A place in a row still needs as many edits as the rest of the text and that of the entry differ in length.
            left = (size + depth - place).astype(np.int32)
            row_and_rest = row + np.maximum(
                np.maximum(left - self.longest[depth][child].astype(np.int32)[:, None], self.shortest[depth][child].astype(np.int32)[:, None] - left), 0
            )
            alive = (row_and_rest.min(axis=1) <= most[text]) & (self.children[depth][child] > 0)
            if alive.any():
                waiting.append((depth, text[alive], child[alive], row[alive]))


class Entries:
    """A list of different comparable texts: (text, its words sorted, ord)."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.sorted: dict[str, int] = {}
        self.beginnings: dict[str, int] = {}
        plain: dict[str, int] = {}
        for text, by_word, ord_ in rows:
            plain[text] = min(ord_, plain.get(text, ord_))
            self.sorted[by_word] = min(ord_, self.sorted.get(by_word, ord_))
            for n in range(max(1, -(-len(text) // 8)), len(text) * 2 // 3 + 1):
                start = text[:n]
                if ord_ < self.beginnings.get(start, ORD_SPACE):
                    self.beginnings[start] = ord_
        self.plain = plain
        self.lengths = sorted({len(t) for t in plain if t})
        self.longest = max(self.lengths, default=0)
        self.first = min(plain.values(), default=None)
        self.alike = all(a == b for a, b, _ in rows)
        self.tries: tuple[Trie, Trie] | None = None

    def met(self, text: str, by_word: str) -> int:
        """The best rank by equal words or by a beginning; without any, that of score 0."""
        best = rank_of(0, self.first)
        if text:
            equal = self.sorted.get(by_word)
            if equal is not None:
                return int(rank_of(100, equal))
            found = [self.beginnings.get(text, ORD_SPACE)]
            size = len(text)
            found += [self.plain.get(text[:n], ORD_SPACE) for n in self.lengths if n * 3 <= size * 2 and n * 8 >= size]
            if min(found) < ORD_SPACE:
                best = min(best, rank_of(PREFIX_SCORE, min(found)))
        return int(best)

    def best(self, texts: list[tuple[str, str]]) -> list[int]:
        """The best rank for each text and its words sorted; the list must not be empty."""
        ranks = np.array([self.met(*t) for t in texts], np.int64)
        by_length = defaultdict(list)
        for i, (text, _) in enumerate(texts):
            if text:
                by_length[len(text)].append(i)
        for size, found in by_length.items():
            self.nearer(size, np.array(found), texts, ranks)
        return ranks.tolist()

    def nearer(self, size: int, which: np.ndarray, texts: list[tuple[str, str]], ranks: np.ndarray) -> None:
        """Lower the ranks of texts of one length by what is near them."""
        farthest = max(size, self.longest)
        allowed = max(1, size - self.longest, (self.lengths[0] if self.lengths else 0) - size)
        seen = 0  # edits that all entries within have been compared
        while True:
            score = 100 - (ranks[which] >> 48)
            beyond = closeness(seen + 1, max(size, min(self.longest, size + seen + 1)))
            which = which[(score <= beyond) & (seen < farthest)]
            if not len(which):
                return
            # Edits with which the best score so far is still reached.
            most = np.minimum(allowed, farthest * (201 - 2 * (100 - (ranks[which] >> 48))) // 200)
            if self.tries is None:
                self.tries = Trie(self.plain), Trie(self.sorted)
            for trie, side in zip(self.tries, (0, 1)):
                if side and self.alike and all(texts[i][0] == texts[i][1] for i in which.tolist()):
                    continue
                points = np.array([list(map(ord, texts[i][side])) for i in which.tolist()], np.int32).reshape(len(which), -1)
                best = ranks[which]
                trie.search(points, most, best)
                ranks[which] = best
            seen, allowed = allowed, min(2 * allowed, farthest)
