"""Vectorised words and rolling hashes over Arrow text columns.

A block is a run of whole texts whose bytes lie in one array. Words are found by a
byte table, so that the same code serves every definition of a word whose breaks are
ASCII characters. Each word, and each run of words, gets a 64-bit hash.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one block holds unless a single text is longer.
BLOCK_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_places: list[np.ndarray] = []


def spaced_words() -> np.ndarray:
    """True for bytes of words that only the six ASCII blanks end."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_words() -> np.ndarray:
    """True for digits, ASCII letters and all bytes of other characters."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def factors(n: int) -> np.ndarray:
    """A random odd factor for each of the first n places in a word."""
    if not _places or len(_places[0]) < n:
        size = max(n, BLOCK_BYTES)
        _places[:] = [mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_MULT)) | np.uint64(1)]
    return _places[0]


def texts(column: pa.Array) -> pa.Array:
    """The column as binary without nulls: a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


class Block:
    """Texts first .. first+len(offsets)-2 of a column: their bytes and where their words lie."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, is_word: np.ndarray, lower: bool):
        self.first, self.n = first, len(offsets) - 1
        self.data = lower_table()[data] if lower else data
        inside = is_word[data]
        before = np.empty(len(data), dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        breaks = offsets[:-1][offsets[:-1] < len(data)]
        before[breaks] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[breaks[breaks > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Of each text, the first of its words; one more at the end.
        self.bounds = np.searchsorted(self.starts, offsets)
        self.offsets = offsets

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """Of each word, its text."""
        return np.repeat(np.arange(self.n), self.counts())

    def _sums(self) -> np.ndarray:
        """Running sums of bytes times their place's factor; the places are counted from the beginning of each word.

        Factors are random and not powers of a base, as words of a certain shape clash modulo 2**64 for every base.
        """
        n = len(self.data)
        at = np.arange(n)
        begin = np.zeros(n, dtype=np.int64)
        begin[self.starts] = self.starts
        at -= np.maximum.accumulate(begin)
        sums = np.zeros(n + 1, dtype=np.uint64)
        if n:
            np.cumsum(_BYTES[self.data] * factors(int(at.max()) + 1)[at], out=sums[1:])
        return sums

    def hashes(self) -> np.ndarray:
        sums = self._sums()
        return mix(sums[self.ends] - sums[self.starts])

    def beginnings(self, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size: the words that are longer, in bytes, and hashes of their beginnings of that size."""
        sums = self._sums()
        found = []
        for k in sizes:
            long = np.flatnonzero(self.ends - self.starts > k)
            at = self.starts[long]
            found.append((long, mix(sums[at + k] - sums[at] + np.uint64(k))))
        return found

    def left(self) -> np.ndarray:
        """Of each word, how many words of its text begin there or later."""
        return np.repeat(self.bounds[1:], self.counts()) - np.arange(len(self.starts))

    def words(self, k: int) -> list[bytes]:
        a, b = self.bounds[k], self.bounds[k + 1]
        raw = self.data.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        return [raw[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def blocks(column: pa.Array, is_word: np.ndarray, lower: bool = False) -> Iterator[Block]:
    """Cuts a column into blocks, in order; every text is in exactly one."""
    column = texts(column)
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, side="right")) - 1)
        last = min(last, len(column))
        yield Block(data[at[first] : at[last]], at[first : last + 1] - at[first], first, is_word, lower)
        first = last


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, also those across texts: one per place they can start."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = words[:n].copy()
    for j in range(1, k):
        total ^= total >> np.uint64(29)
        total *= np.uint64(_MULT)
        total += words[j : j + n]
    return mix(total)
