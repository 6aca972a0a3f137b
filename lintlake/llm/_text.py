"""Word and window hashes of Arrow text columns, computed on whole buffers.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Word and window hashes are
polynomials modulo 2**64 read off prefix sums, then mixed; a hash depends on the word or window
alone, never on where it stands, so equal words have equal hashes on every executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # text bytes worked on at a time; a longer document is a chunk of its own
LONG_WORD = 1 << 16  # longer words get a digest instead of a polynomial
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def _odd(seed: int) -> int:
    digest = hashlib.blake2b(str(seed).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") | 1


class _Powers:
    """Powers of an odd number and of its inverse, as many as were asked for."""

    def __init__(self, seed: int) -> None:
        self.base = _odd(seed)
        self.up = self.down = np.ones(1, _U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = 1 << int(n).bit_length()
            grown = []
            for base in (self.base, pow(self.base, -1, 1 << 64)):
                steps = np.full(size + 1, base, _U)
                steps[0] = 1
                grown.append(np.multiply.accumulate(steps))
            self.up, self.down = grown
        return self.up, self.down


_powers: dict[int, _Powers] = {}


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial of values[s:e] for every range, relative to its own start."""
    up, down = _powers.setdefault(seed, _Powers(seed)).of(len(values))
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Chunk:
    """Some rows of a batch. Row `k` has the words first[k] to first[k + 1]."""

    row: int  # first row in the batch
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def word_hashes(self, seed: int = 1) -> np.ndarray:
        n = len(self.starts)
        out = np.empty(n, _U)
        if not n:
            return out
        # Blocks of words that span at most CHUNK bytes keep the tables of powers small.
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + CHUNK)))
            lo, hi = self.starts[at], self.ends[to - 1]
            if to == at + 1 and hi - lo > LONG_WORD:
                out[at] = 0  # replaced below
            else:
                part = self.buf[lo:hi].astype(_U) + _U(1)
                out[at:to] = _ranges(part, self.starts[at:to] - lo, self.ends[at:to] - lo, seed)
            at = to
        size = self.ends - self.starts
        out ^= size.astype(_U) * _U(0x9E3779B97F4A7C15)
        for k in np.flatnonzero(size > LONG_WORD):
            word = self.buf[self.starts[k]:self.ends[k]].tobytes()
            digest = hashlib.blake2b(word, digest_size=8, salt=str(seed).encode()[:16]).digest()
            out[k] = int.from_bytes(digest, "little")
        return mix(out)

    def bytes_of(self, k: int) -> bytes:
        """Text of row k from its first to its last word."""
        a, b = self.first[k], self.first[k + 1]
        return self.buf[self.starts[a]:self.ends[b - 1]].tobytes() if b > a else b""


def windows(words: np.ndarray, first: np.ndarray, length: int, seed: int = 7):
    """Hashes of all windows of `length` words within rows: (hashes, start word, row)."""
    count = np.maximum(np.diff(first) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    start = np.arange(len(row)) - before[row] + first[:-1][row]
    return mix(_ranges(words, start, start + length, seed)), start, row


def whole_rows(words: np.ndarray, first: np.ndarray, seed: int = 9) -> np.ndarray:
    """One hash for the word sequence of every row."""
    size = np.diff(first).astype(_U)
    return mix(_ranges(words, first[:-1], first[1:], seed) ^ (size * _U(0xD6E8FEB86659FD93)))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, lower: bool = False) -> Iterator[Chunk]:
    """The rows of a text column, about CHUNK bytes at a time."""
    data, at = text_buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        buf = data[at[row]:at[to]]
        cuts = at[row:to + 1] - at[row]
        if lower:
            buf = lower_ascii(buf)
        solid = ~_SPACE[buf]
        before = np.zeros(len(buf) + 1, bool)
        before[1:] = solid
        after = np.zeros(len(buf) + 1, bool)
        after[:-1] = solid
        before[cuts] = False
        after[cuts] = False
        starts = np.flatnonzero(solid & ~before[:-1])
        ends = np.flatnonzero(solid & ~after[1:]) + 1
        yield Chunk(row, buf, starts, ends, np.searchsorted(starts, cuts))
        row = to
