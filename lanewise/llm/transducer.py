"""A byte pair vocabulary compiled into a deterministic transducer.

The input of the transducer is one word piece (a run of letters, a digit, a run
of signs or a contraction); the output is its tokens. Merges look ahead, so a
state is the part of the piece whose tokens are still open, and a transition
carries the tokens that its character settles.

Which tokens are settled: the encodings of all beginnings of a piece form a
tree, as cutting an encoding at one of its token borders gives the encoding of
that beginning. Whatever follows, the token that reaches beyond the characters
read so far starts at a place from which those characters are the beginning of
some token. The deepest border that lies on the tree's paths to all such places
is a border of every continuation: what is before it is emitted, what is behind
it names the state. States are made when a text first needs them.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

FAR = 1 << 30  # later than any merge
MOST_STATES = 200_000  # then they are made anew
END = "Ā"  # marks the last character of a piece; characters are bytes as Latin-1


def byte_letters() -> dict[str, str]:
    """The letters that byte-level vocabularies use for bytes, to Latin-1."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class State(dict):
    """Transitions of one state: character to (state, tokens, their ids).

    ``open`` are the characters whose tokens are not settled. The last of them
    may still be the piece's end; of the others, ``parent`` has the tree of
    borders (place 0 is its root) and ``alive`` the places from which the
    characters read so far are the beginning of some token.
    """

    __slots__ = ("machine", "open", "parent", "alive", "ending")

    def __init__(self, machine: Transducer, open_part: str, parent: dict[int, int], alive: tuple[int, ...]):
        super().__init__()
        self.machine, self.open, self.parent, self.alive, self.ending = machine, open_part, parent, alive, None

    def __missing__(self, char: str):
        step = self[char] = self.machine.step(self, char)
        return step


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, letters = spec["model"]["end_of_word_suffix"], byte_letters()

        def plain(token: str) -> str:
            ends = token.endswith(suffix)
            return "".join(letters[c] for c in (token[: -len(suffix)] if ends else token)) + END * ends

        self.ids = {plain(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks = {(plain(a), plain(b)): r for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        # Letter case, character classes and composition are those of the library's own Unicode tables.
        library = Tokenizer.from_file(path)
        self.normal, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.latin = str.maketrans(letters)
        self.beginnings = {t[:n] for t in (t.rstrip(END) for t in self.ids) for n in range(len(t))}
        self.edges: dict[str, tuple | None] = {}
        self.states: dict[str, State] = {}
        self.pieces = Known(self.piece, 150_000)
        self.start = self.states[""] = State(self, "", {}, (0,))

    def sides(self, token: str) -> tuple | None:
        """What stands at the left and at the right edge of a token while it is merged.

        Each symbol comes with the rank of the merge that ends it. None if the
        merges do not lead to the token.
        """
        if token not in self.edges:
            text = token.rstrip(END)
            parts = [(c, (), ()) for c in text[:-1]] + [(text[-1] + token[len(text) :], (), ())]
            while len(parts) > 1:
                rank, at = min((self.ranks.get((x[0], y[0]), FAR), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if rank == FAR:
                    break
                (x, left, _), (y, _, right) = parts[at], parts[at + 1]
                parts[at : at + 2] = [(x + y, (*left, (x, rank)), (*right, (y, rank)))]
            whole, left, right = parts[0]
            done = len(parts) == 1
            self.edges[token] = ((*left, (whole, FAR)), (*right, (whole, FAR))) if done else None
        return self.edges[token]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether two tokens side by side keep the border between them.

        They lose it if two symbols that face each other there merge before
        either is used up; of merges with equal rank, the left one comes first.
        """
        facing, ranks = self.sides(right)[0], self.ranks
        for x, x_ends in self.sides(left)[1]:
            for y, y_ends in facing:
                rank = ranks.get((x, y), FAR)
                if rank < x_ends and rank <= y_ends and rank < FAR:
                    return False
        return True

    def last_border(self, state: State, text: str) -> int:
        """Where the last token of the encoding of ``text`` starts."""
        for place in state.alive:
            token = text[place:]
            if token in self.ids and self.sides(token):
                if not place or self.stay_apart(text[state.parent[place] : place], token):
                    return place
        raise ValueError(f"the vocabulary has no token for a part of {text!r}")

    def path(self, text: str, parent: dict[int, int], end: int) -> list[int]:
        """Ids of the tokens of ``text`` up to the border at ``end``."""
        out = []
        while end:
            begin = parent[end]
            out.append(self.ids[text[begin:end]])
            end = begin
        return out[::-1]

    def step(self, state: State, char: str) -> tuple[State, int, bytes]:
        """The open part is now known to go on, so its last character is no piece's end."""
        text, parent = state.open, dict(state.parent)
        end = len(text)
        if end:
            parent[end] = self.last_border(state, text)
        alive = [k for k in state.alive if k < end and text[k:] in self.beginnings] + [end]
        common: list[int] | None = None
        for place in alive:
            way = [place]
            while way[-1]:
                way.append(parent[way[-1]])
            common = way if common is None else [p for p in common if p in way]
        settled = max(common)
        ids = np.array(self.path(text, parent, settled), "<u4").tobytes()
        name = text[settled:] + char
        after = self.states.get(name)
        if after is None:
            kept = {k - settled: parent[k] - settled for k in parent if k > settled and parent[k] >= settled}
            after = self.states[name] = State(self, name, kept, tuple(k - settled for k in alive))
        return after, len(ids) // 4, ids

    def ending(self, state: State) -> tuple[int, bytes]:
        if state.ending is None:
            text = state.open + END
            last = self.last_border(state, text)
            ids = [*self.path(text, state.parent, last), self.ids[text[last:]]]
            state.ending = len(ids), np.array(ids, "<u4").tobytes()
        return state.ending

    def piece(self, piece: str) -> bytes:
        """Ids of a word piece, as little-endian numbers of 4 bytes."""
        if len(self.states) > MOST_STATES:
            self.states.clear()
            self.start = self.states[""] = State(self, "", {}, (0,))
        state, ids = self.start, []
        for char in piece:
            state, emitted, out = state[char]
            if emitted:
                ids.append(out)
        ids.append(self.ending(state)[1])
        return b"".join(ids)

    def word(self, word: bytes) -> bytes:
        """Ids of a text without white space in ASCII."""
        text = word.decode("utf-8", "replace")
        if text.isalpha() and text.isascii():
            return self.pieces[text.lower()]
        ids, done = [], 0
        # Special tokens match before anything else.
        for found in self.specials.finditer(text):
            ids += self.plain(text[done : found.start()])
            ids.append(np.array([self.special[found[0]]], "<u4").tobytes())
            done = found.end()
        return b"".join(ids + self.plain(text[done:]))

    def plain(self, text: str) -> list[bytes]:
        """Ids of the pieces of a text without special tokens."""
        return [self.pieces[piece.translate(self.latin)] for piece, _ in self.cut(self.normal(text))] if text else []


class Known(dict):
    """Results for texts met lately, and for as many before them; long texts are not kept."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, text):
        result = self.old.get(text)
        if result is None:
            result = self.compute(text)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(text) <= 64:
            self[text] = result
        return result


def counts(path: str) -> Known:
    """Word in UTF-8, without white space in ASCII, to the number of its tokens."""
    word = Transducer(path).word
    return Known(lambda text: len(word(text)) // 4, 300_000)
