"""Hashes of many spans of a batch of texts at once, in numpy.

Texts of a batch lie one behind another in one byte array. A prefix sum of byte codes times powers of an odd base gives
the hash of any span by one subtraction and one product with the inverse power, all modulo 2**64. Hashes are mixed at
the end, so that equal low bits of such sums do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def pieces(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `most` bytes of text; one text is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += int(n)
    if at < len(sizes):
        yield batch.slice(at)


class Spans:
    """Prefix sums over the texts of an Arrow string array; nulls count as empty."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if texts.offset:
            texts = pa.concat_arrays([texts])
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        self.at = at - at[0]
        n = len(self.bytes)
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, U)
        np.cumsum(_CODES[self.bytes] * up[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(U))

    def window(self, width: int) -> np.ndarray:
        """The hash of the width bytes that end at each place; places before width - 1 have no meaning."""
        out = np.zeros(len(self.bytes), U)
        if len(self.bytes) >= width:
            ends = np.arange(width, len(self.bytes) + 1)
            out[width - 1 :] = mix((self._sums[ends] - self._sums[ends - width]) * self._down[ends - width])
        return out

    def text(self, start: int, end: int) -> str:
        return self.bytes[start:end].tobytes().decode("utf-8", "replace")


def tokens(texts: pa.Array) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the lower-cased texts, and of each token its text's number, start and end.

    A token is a run of a-z and 0-9 of two or more characters.
    """
    s = Spans(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(s.bytes)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _TOKEN[s.bytes]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = s.at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start >= 2
    start, end = start[long], end[long]
    return s, np.searchsorted(s.at, start, side="right") - 1, start, end


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Places in sorted keys where a new value begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
