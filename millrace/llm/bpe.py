"""Byte-pair encoding as a lazily determinised transducer.

The merges of a rank file define, for every byte string, one sequence of tokens. Each prefix of a word has a last
token; a token may follow another only if encoding both together leaves them apart. So the encoding can be read from
left to right: a state holds the tail of the word that may still grow into a token, with the pending tokens behind
each place where one could start. Tokens that all these places share can no longer change and are emitted. States and
transitions are built when first met and kept.
"""

from __future__ import annotations

import base64
from itertools import chain

import regex

#: Fixed value: the published pattern of the byte-level vocabularies that splits a text into words before the merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_BYTES = [bytes([k]) for k in range(256)]
_EMPTY = ((0, ()),)


class Transducer:
    """States are numbers. step[state << 8 | byte] is (next state, tokens emitted); final[state] has the tokens left at the end."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        # what bytes can be: a token that may still grow (its number), one that can't (-2 - number), or a head only (-1)
        self.reach = {t[:k]: -1 for t in ranks for k in range(1, len(t))}
        self.reach.update([(t, i if t in self.reach else -2 - i) for t, i in ranks.items()])
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drops all states and transitions; they are built again when met."""
        self._number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.final: list[tuple[int, ...]] = []
        self.start = self._state((b"", ((0, ()),), None))

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """The plain rule: merge the pair of lowest rank, below a limit, until none is left."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte."""
        if token not in self._halves:
            piece = self.bytes_of[token]
            # without its own rank, a token's bytes merge to just the two parts of its last merge
            parts = self.merge(piece, token) if len(piece) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: undoing the latest merges beside the border, one after another, no
        merge across it may come before the ones undone so far."""
        key = (a, b)
        known = self._apart.get(key)
        if known is None:
            left, right, before, known = a, b, 1 << 60, True
            while True:
                across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
                if across is not None and across < before:
                    known = False
                    break
                x, y = self.halves(left), self.halves(right)
                if x and (left > right or not y):
                    # at equal rank the merge further left comes first, so one across must be earlier than this one
                    before, left = left, x[1]
                elif y:
                    before, right = right + 1, y[0]
                else:
                    break
            self._apart[key] = known
        return known

    def _state(self, key: tuple) -> int:
        """A state is (tail, paths, before). tail: the bytes from the first open place on; paths: each open place in it,
        in order, with the tokens not yet emitted that lead there, the last place being the end; before: the last token
        emitted, if a path has none of its own."""
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self.states)
            self.states.append(key)
            self.final.append(key[1][-1][1])
        return number

    def advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        tail, paths, before = self.states[state]
        tail += _BYTES[byte]
        get = self.reach.get
        found, live = None, []
        for pair in paths:
            can = get(tail[pair[0] :])
            if can is None:
                continue
            if can != -1 and found is None:
                path = pair[1]
                token = can if can >= 0 else -2 - can
                last = path[-1] if path else before
                if last is None or self.apart(last, token):
                    found = (*path, token)
            if can >= -1:
                live.append(pair)
        if found is None:
            raise ValueError("these ranks don't cover every byte")
        if not live:
            made = (self._state((b"", _EMPTY, found[-1])), found)
        else:
            live.append((len(tail), found))
            first, path = live[0]
            shared, least = 0, min(len(path), len(found))
            if least:
                least = min([len(x) for _, x in live])
            while shared < least and all([x[shared] == found[shared] for _, x in live]):
                shared += 1
            if first or shared:
                live = [(p - first, x[shared:]) for p, x in live]
            needed = (found[shared - 1] if shared else before) if any([not x for _, x in live]) else None
            made = (self._state((tail[first:], tuple(live), needed)), found[:shared])
        self.step[state << 8 | byte] = made
        return made

    def encode(self, piece: bytes) -> tuple[int, ...]:
        out: list[int] = []
        state, get = self.start, self.step.get
        for byte in piece:
            state, made = get(state << 8 | byte) or self.advance(state, byte)
            if made:
                out += made
        return (*out, *self.final[state])


class Words(dict):
    """Encodings of words, each run through the transducer once. Both are emptied beyond a size, so memory is bounded."""

    def __init__(self, transducer: Transducer, most: int = 120_000):
        super().__init__()
        self.transducer, self.most = transducer, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        if len(self.transducer.states) >= self.most:
            self.transducer.forget()
        ids = self.transducer.encode(word.encode())
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts by the ranks of a file. Null and empty texts have no tokens. Special tokens are never made."""

    def __init__(self, path: str, pattern: str = WORD_PATTERN):
        self.transducer = Transducer(read_ranks(path))
        self.words = Words(self.transducer)
        self.split = regex.compile(pattern).findall

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, self.split(text)))) if text else 0

    def decoder(self) -> Decoder:
        return Decoder(self.transducer.bytes_of)


class Decoder:
    """Turns a stream of ids back into text. feed() gives what is complete; a character cut between tokens waits."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.need, self.held = bytes_of, 0, bytearray()

    def feed(self, ids) -> str:
        out = bytearray()
        for i in ids:
            for b in self.bytes_of[i]:
                if self.need and b >> 6 == 2:
                    self.need -= 1
                else:  # a new character begins; an unfinished one stays as it is and is replaced below
                    self.need = 3 if b >= 0xF0 else 2 if b >= 0xE0 else 1 if b >= 0xC0 else 0
                    out += self.held
                    self.held.clear()
                self.held.append(b)
                if not self.need:
                    out += self.held
                    self.held.clear()
        return out.decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.need = self.held.decode("utf-8", "replace"), 0
        self.held.clear()
        return rest
