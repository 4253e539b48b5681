"""Words of whole Arrow text columns at once: where they are, and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from colloquy.llm.hashing import RangeHashes, mixed

#: Bytes of text whose words are found together; a longer text is alone.
SLICE_BYTES = 2 << 20
#: Longer words are hashed one by one: sums of powers repeat on long regular strings.
LONG_WORD = 256
#: Kinds of bytes.
INSIDE, SPACE, BREAK = 0, 1, 2
WHITE = b" \t\n\x0b\x0c\r"


def byte_kinds(space: bytes, breaks: bytes = b"") -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(space)] = SPACE
    kinds[list(breaks)] = BREAK
    return kinds


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of some rows of a text column, A-Z lower-cased, in order.

    ``row`` is a word's row, ``start`` and ``end`` its bytes in ``raw``, and
    ``opens`` says that it does not follow the word before within one piece.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kinds: np.ndarray):
        self.raw = _LOWER[raw]
        self.offsets = offsets
        inside = kinds[self.raw] == INSIDE
        first, last = offsets[:-1], offsets[1:]
        full = first < last
        # A word begins after a byte that is no part of one, or with its text.
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[first[full]] = inside[first[full]]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[last[full] - 1] = inside[last[full] - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(last, self.start, side="right")
        self.opens = np.ones(len(self.start), bool)
        if len(self.start):
            breaks = np.r_[0, np.cumsum(kinds[self.raw] == BREAK)]
            piece = breaks[self.start]
            self.opens[1:] = (piece[1:] != piece[:-1]) | (self.row[1:] != self.row[:-1])

    def hashes(self) -> np.ndarray:
        found = RangeHashes(self.raw).of(self.start, self.end)
        for k in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            found[k] = xxhash.xxh3_64_intdigest(self.raw[self.start[k] : self.end[k]].tobytes())
        return found

    def text(self, first: int, last: int) -> str:
        """The words from ``first`` to ``last``, joined by one space."""
        return b" ".join(
            self.raw[a:b].tobytes() for a, b in zip(self.start[first : last + 1], self.end[first : last + 1])
        ).decode()


def words_of(column: pa.Array, kinds: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for slices of a text column; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        after = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        after = min(max(after, first + 1), len(column))
        a, b = int(offsets[first]), int(offsets[after])
        yield first, after, Words(raw[a:b], offsets[first : after + 1] - a, kinds)
        first = after


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive word hashes."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out
