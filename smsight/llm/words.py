"""Words, shingles and their 64-bit hashes for whole Arrow batches, computed on the bytes of the text column.

A word is a run of bytes that an alphabet calls inside; A-Z count as a-z. In UTF-8 every byte of a character beyond
ASCII is at least 0x80, so word rules that speak of ASCII characters only can be told byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # text handled at a time; a longer text is a slice of its own
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RADIX = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_RADIX, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Alphabet:
    """Which bytes belong to words, and a random 64-bit code for each byte (upper case has the code of lower case)."""

    def __init__(self, separators: bytes | None = None, inside: bytes | None = None):
        table = np.zeros(256, bool) if inside is not None else np.ones(256, bool)
        table[list(inside if inside is not None else separators)] = inside is not None
        table[65:91] = table[97:123]
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        self.inside = table
        self.code = mix((lower + np.uint64(1)) * _MULTIPLIER)


SPACED = Alphabet(separators=b"\x20\x09\x0a\x0b\x0c\x0d")
ALPHANUMERIC = Alphabet(inside=bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
LETTERS = Alphabet(inside=bytes([*range(97, 123), *range(128, 256)]))

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one have at most ``size`` bytes, or are one text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after each other (null: none), and where each begins, with the end."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a slice: ``starts`` and ``ends`` in bytes, and ``first``: the words of text i are first[i]:first[i+1]."""

    def __init__(self, column: pa.Array, alphabet: Alphabet):
        self.data, self.offsets = text_bytes(column)
        self.alphabet = alphabet
        inside = alphabet.inside[self.data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        begin[edges] = inside[edges]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        edges = edges[edges > 0] - 1
        end[edges] = inside[edges]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._sums = None

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first bytes (0 where the word is not longer than those)."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.alphabet.code[self.data] * _power(_RADIX, n), dtype=np.uint64, out=self._sums[1:])
        ends = self.ends if prefix is None else np.minimum(self.starts + prefix, self.ends)
        out = mix((self._sums[ends] - self._sums[self.starts]) * _power(_INVERSE, n + 1)[self.starts])
        if prefix is not None:
            out = mix(out + np.uint64(prefix))
            out[self.ends - self.starts <= prefix] = 0
        return out

    def word(self, i: int) -> str:
        return bytes(self.data[self.starts[i]:self.ends[i]]).decode("utf-8", "replace")

    def spans_of(self, text: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans of one text's words, counted from its beginning."""
        part = slice(self.first[text], self.first[text + 1])
        return self.starts[part] - self.offsets[text], self.ends[part] - self.offsets[text]


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, and where each text's begin, with the end.

    A text with fewer words has one run, of all of them; a text without words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begins = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=begins[1:])
    value = np.zeros(max(0, len(hashes)), np.uint64)
    for step in range(size):
        shifted = hashes[step:]
        value[:len(shifted)] = value[:len(shifted)] * np.uint64(_RADIX) + shifted
    full = counts >= size
    # the runs that begin at the last size-1 words of a text would reach into the next one
    keep = np.ones(len(hashes), bool)
    ends = first[1:]
    for step in range(1, size):
        at = ends - step
        keep[at[full]] = False
    short = np.flatnonzero((counts > 0) & ~full)
    for i in short:
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in hashes[first[i]:first[i + 1]]:
                total = total * np.uint64(_RADIX) + h
        value[first[i]] = total + np.uint64(counts[i])
        keep[first[i] + 1:first[i + 1]] = False
    return mix(value[keep]), begins
