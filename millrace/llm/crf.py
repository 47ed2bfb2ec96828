"""A linear-chain conditional random field over words, in numpy.

The score of a label at a word is a sum over the words around it: each word contributes, by its place relative to the
labelled word, the weights of its attributes (itself, its shape, its ends). So what a distinct word contributes is
computed once and looked up afterwards. Sequences are trained and decoded in batches of equal padding.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Places around a word that count, and hashed attributes at each.
REACH, SLOTS = 4, 1 << 14
#: Given names that are common in several languages: a small gazetteer.
GIVEN = "Adam Ahmed Aisha Alan Alexander Ali Alice Amara Amina Amy Ana Anders Andrea Andrew Angela Anita Anna Anton Antonio Arjun Astrid Barbara Beatrice Ben Björn Bruno Camille Carla Carlos Caroline Chloé Chris Christine Clara Claire Daniel David Deepa Denis Diana Diego Dmitri Elena Elif Elizabeth Emil Emily Emma Erik Esther Eva Fatima Felix Fernando Francesca Gabriel George Giulia Greta Hanna Hans Hassan Helen Henrik Henry Hiroshi Hugo Ibrahim Igor Ines Ingrid Irene Isabel Ivan Jacob James Jan Jana Javier Jean Jennifer Joan John Jonas José Julia Jürgen Karin Karl Kate Kenji Kevin Laura Lars Leila Lena Leo Linda Linh Lisa Louis Lucas Lucia Luis Luka Magnus Malik Marco Margaret Maria Marie Martin Mary Matteo Maya Mehmet Mei Michael Milan Miriam Mohamed Monika Nadia Naomi Natalia Nathan Nicolas Nikolai Nina Noah Nora Nuria Olga Oliver Omar Oskar Pablo Patricia Paul Paula Pavel Pedro Peter Petra Philip Pierre Priya Rachel Rafael Rania Ravi Rebecca Richard Robert Rosa Samuel Sandra Sara Sergei Signe Simon Sofia Stefan Susan Sven Tariq Teresa Thomas Tilda Tomas Ursula Valentina Vera Viktor Walter Wanda Wei William Yasmin Yuki Yusuf Zara Zoë".split()
_GIVEN = frozenset(x.lower() for x in GIVEN)
WORD = re.compile(r"\+?\w(?:[\w@.+'’\-]*\w)?|[^\w\s]")


def words_of(text: str) -> list[tuple[int, str]]:
    """(start, word): words with marks inside them, and other marks one by one."""
    return [(m.start(), m.group()) for m in WORD.finditer(text)]


def shape(word: str) -> str:
    return "".join("X" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c for c in word)


def attributes(word: str) -> list[int]:
    """Slots of a word's attributes, always as many."""
    low, form = word.lower(), shape(word)
    short = re.sub(r"(.)\1+", r"\1", form)
    digits = sum(c.isdigit() for c in word)
    found = ("w" + low, "s" + form[:24], "c" + short[:24], f"g{low in _GIVEN}{short[:2]}", "p" + low[:3], "e" + low[-3:], "f" + low[-5:], f"d{digits}/{min(len(word), 24)}", f"l{min(len(word), 24)}{short[:1]}", f"@{'@' in word}{'.' in word}{'[' in word}")
    return [zlib.crc32(x.encode()) % SLOTS for x in found]


class Vocabulary:
    """Numbers words; 0 stands for a place outside the text."""

    def __init__(self, most: int = 200_000):
        self.number, self.rows, self.most = {"": 0}, [attributes("")], most

    def of(self, word: str) -> int:
        k = self.number.get(word)
        if k is None:
            k = self.number[word] = len(self.rows)
            self.rows.append(attributes(word))
        return k


def _window(ids: np.ndarray) -> np.ndarray:
    """(batch, time, place): the word numbers around each word."""
    padded = np.pad(ids, ((0, 0), (REACH, REACH)))
    return np.stack([padded[:, k : k + ids.shape[1]] for k in range(2 * REACH + 1)], axis=2)


class Tagger:
    def __init__(self, labels: list[str], weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.labels = labels
        n = len(labels)
        self.weights = np.zeros((2 * REACH + 1, SLOTS, n), np.float32) if weights is None else weights
        self.moves = np.zeros((n + 1, n), np.float32) if moves is None else moves  # the last row: from the start
        self.forget()

    def __getstate__(self):
        return self.labels, self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self.vocabulary = Vocabulary()
        self.table = np.zeros((0, 2 * REACH + 1, len(self.labels)), np.float32)

    def _scores(self, ids: np.ndarray) -> np.ndarray:
        if len(self.table) < len(self.vocabulary.rows):
            new = np.array(self.vocabulary.rows[len(self.table) :])
            self.table = np.concatenate([self.table, np.stack([w[new].sum(axis=1) for w in self.weights], axis=1)])
        around = _window(ids)
        return sum(self.table[around[:, :, k], k] for k in range(2 * REACH + 1))

    def fit(self, sentences: list[tuple[list[str], list[int]]], epochs: int = 6, rate: float = 0.2, decay: float = 1e-5, batch: int = 64, seed: int = 5) -> Tagger:
        """Stochastic gradients of the log-likelihood, scaled by the root of their summed squares."""
        rng = np.random.default_rng(seed)
        vocabulary = Vocabulary()
        coded = [(np.array([vocabulary.of(w) for w in words]), np.array(tags)) for words, tags in sentences if words]
        attrs = np.array(vocabulary.rows)
        squares, move_squares = np.full(self.weights.shape, 1e-3, np.float32), np.full(self.moves.shape, 1e-3, np.float32)
        n = len(self.labels)
        for _ in range(epochs):
            order = rng.permutation(len(coded))
            order = sorted((order[k : k + batch * 16] for k in range(0, len(order), batch * 16)), key=lambda _: rng.random())
            order = np.concatenate([sorted(o, key=lambda k: len(coded[k][0])) for o in order])
            for at in range(0, len(order), batch):
                some = [coded[k] for k in order[at : at + batch]]
                size, long = len(some), max(len(x) for x, _ in some)
                ids, tags, here = np.zeros((size, long), int), np.zeros((size, long), int), np.zeros((size, long), bool)
                for k, (x, y) in enumerate(some):
                    ids[k, : len(x)], tags[k, : len(y)], here[k, : len(x)] = x, y, True
                around = _window(ids)
                score = np.zeros((size, long, n))
                for k in range(2 * REACH + 1):
                    score += self.weights[k][attrs[around[:, :, k]]].sum(axis=2)
                inner, first = self.moves[:n].astype(float), self.moves[n].astype(float)
                a, b = np.zeros((size, long, n)), np.zeros((size, long, n))
                a[:, 0] = score[:, 0] + first
                for t in range(1, long):
                    step = _sum(a[:, t - 1, :, None] + inner, 1) + score[:, t]
                    a[:, t] = np.where(here[:, t, None], step, a[:, t - 1])
                for t in range(long - 2, -1, -1):
                    step = _sum(inner + (score[:, t + 1] + b[:, t + 1])[:, None, :], 2)
                    b[:, t] = np.where(here[:, t + 1, None], step, 0.0)
                total = _sum(a[:, -1], 1)
                p = np.exp(a + b - total[:, None, None]) * here[:, :, None]
                gold = np.zeros_like(p)
                np.put_along_axis(gold, tags[:, :, None], 1.0, axis=2)
                gold *= here[:, :, None]
                slope = ((gold - p) / size).astype(np.float32)
                pair = np.zeros((n + 1, n))
                pair[n] = (gold[:, 0] - p[:, 0]).sum(axis=0)
                for t in range(1, long):
                    h = here[:, t]
                    if h.any():
                        q = np.exp(a[h, t - 1, :, None] + inner + (score[h, t] + b[h, t])[:, None, :] - total[h, None, None]).sum(axis=0)
                        pair[:n] -= q
                        np.add.at(pair, (tags[h, t - 1], tags[h, t]), 1.0)
                flat = slope[here]
                for k in range(2 * REACH + 1):
                    slots = attrs[around[:, :, k][here]]
                    used, where = np.unique(slots, return_inverse=True)
                    g = np.zeros((len(used), n), np.float32)
                    np.add.at(g, where.reshape(slots.shape), flat[:, None, :])
                    g -= decay * self.weights[k][used]
                    squares[k][used] += g * g
                    self.weights[k][used] += rate * g / np.sqrt(squares[k][used])
                g = pair / size
                move_squares += g * g
                self.moves += (rate * g / np.sqrt(move_squares)).astype(np.float32)
        self.forget()
        return self

    def decode(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each sequence (Viterbi), in batches of similar length."""
        if len(self.vocabulary.rows) > self.vocabulary.most:
            self.forget()
        coded = [np.array([self.vocabulary.of(w) for w in s], int) for s in sentences]
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sentences)
        order = sorted((k for k in range(len(coded)) if len(coded[k])), key=lambda k: len(coded[k]))
        n, at = len(self.labels), 0
        while at < len(order):
            long = len(coded[order[at]])
            some = [order[at]]
            while at + len(some) < len(order) and len(coded[order[at + len(some)]]) <= long + 2 + long // 4 and len(some) * long < 60_000:
                some.append(order[at + len(some)])
            at += len(some)
            long = len(coded[some[-1]])
            ids = np.zeros((len(some), long), int)
            sizes = np.array([len(coded[k]) for k in some])
            for k, s in enumerate(some):
                ids[k, : sizes[k]] = coded[s]
            score = self._scores(ids)
            best, back = score[:, 0] + self.moves[n], np.zeros((len(some), long, n), np.int8)
            for t in range(1, long):
                step = best[:, :, None] + self.moves[:n]
                back[:, t] = step.argmax(axis=1)
                best = np.where((t < sizes)[:, None], np.take_along_axis(step, back[:, t][:, None, :].astype(int), 1)[:, 0] + score[:, t], best)
            last = best.argmax(axis=1)
            tags = np.zeros((len(some), long), int)
            for t in range(long - 1, -1, -1):
                tags[:, t] = last
                last = np.where(t < sizes, np.take_along_axis(back[:, t], last[:, None], 1)[:, 0], last)
            for k, s in enumerate(some):
                out[s] = tags[k, : sizes[k]]
        return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of a sum of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)
