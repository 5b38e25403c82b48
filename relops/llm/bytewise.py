"""Whole Arrow batches of text as one byte array: words, lines and rolling hashes without a loop over rows.

All separators of the operators are ASCII, so UTF-8 can be cut byte by byte. Hashes are polynomial, modulo 2**64,
over random values for the 256 bytes, so the hash of any slice is a difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Text worked on at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

# The word classes of the operators: anything but white space, or digits, lower-case letters and non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LINES = np.ones(256, bool)
LINES[0x0A] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""

    up = np.full(length, _BASE, np.uint64)
    down = np.full(length, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE_BYTES, 1 << max(length, 1).bit_length())
    up, down = _powers(size)
    return up[:length], down[:length]


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""

    z = values.astype(np.uint64, copy=True) if not seed else values + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair; equal slices hash alike wherever they stand."""

    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` values, also across documents; see ``Words.whole`` for those inside one."""

    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[:count])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; a null is an empty text."""

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each."""

    first, count = 0, len(offsets) - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, count)
        first = min(last, count)


@dataclass
class Words:
    """Words of some documents: byte range and hash of each, and the first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def whole(self, n: int) -> np.ndarray:
        """For each run of ``n`` words: does it lie inside one document?"""

        return inside(self.first, n)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For each start of ``n`` items in a row: does the run lie inside one of the documents beginning at ``first``?"""

    total = int(first[-1])
    fits = np.ones(max(total - n + 1, 0), bool)
    for begin in first[1:-1]:
        fits[max(begin - n + 1, 0) : begin] = False
    return fits


def cut(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``kept`` bytes that cross no document: starts, ends, and the first run of each document."""

    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inner = kept[data]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens = inner.copy()
    opens[1:] &= ~inner[:-1]
    opens[begins] = inner[begins]
    closes = inner.copy()
    closes[:-1] &= ~inner[1:]
    closes[begins[1:] - 1] = inner[begins[1:] - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> Words:
    """Words of the documents, with the hash of each."""

    starts, ends, first = cut(data, offsets, kept)
    return Words(starts, ends, first, slice_hashes(byte_values(data), starts, ends))


def words_by_piece(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """As ``words_of``, a piece at a time to hold less memory; ``fold`` maps bytes first, as to lower case."""

    parts = []
    for begin, end in pieces(offsets):
        at = offsets[begin]
        text = data[at : offsets[end]]
        part = words_of(text if fold is None else fold[text], offsets[begin : end + 1] - at, kept)
        parts.append((part.starts + at, part.ends + at, part.counts, part.hashes))
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(1, np.int64), np.zeros(0, np.uint64))
    starts, ends, counts, hashes = (np.concatenate(x) for x in zip(*parts))
    return Words(starts, ends, np.concatenate([[0], np.cumsum(counts)]), hashes)


def run_lists(flags: np.ndarray, first: np.ndarray) -> pa.Array:
    """Maximal runs of set flags of each document, as lists of (start, end) counted from its first item."""

    opens, closes, run = cut(flags.view(np.uint8), first, np.arange(256) == 1)
    base = np.repeat(first[:-1], np.diff(run))
    pairs = pa.StructArray.from_arrays([pa.array(opens - base, pa.int64()), pa.array(closes - base, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(run, pa.int32()), pairs)


def masked_texts(data: np.ndarray, mask: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The masked bytes of each document."""

    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=upto[1:])
    at = np.ascontiguousarray(upto[offsets])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[mask]))])


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the position of its smallest, the leftmost of equal ones."""

    at = np.arange(len(values), dtype=np.int32)
    least, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.where(later, least[step:], least[:-step])
        reach += step
    return at


def cover(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Which of ``length`` places lie in any of the ranges."""

    edges = np.zeros(length + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0


def per_document(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each document."""

    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
