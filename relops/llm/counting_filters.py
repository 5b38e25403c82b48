"""Counting quotient filters of short word-id sequences: lossless, sorted, compact, and mergeable.

A sequence of word ids is packed into one number, the number is scrambled by an invertible permutation, and its upper
bits, the quotient, say where it stands while its lower bits, the remainder, are stored in full. So a filter gives
back exactly the sequences that were counted. Filters that cover the same range of scrambled numbers are merged as
sorted streams, whatever number of quotient bits each was built with.

A number may be wider than 64 bits: it is held in two limbs, ``high`` and ``low``, which are also the two halves that
the permutation, a Feistel network, works on.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from relops.llm.bytewise import mixed

ROUNDS = 4
# Word ids have this many bits at most, so that three of them fit two limbs.
MOST_ID_BITS = 42
# A count of this and more is stored in full behind the one-byte counts.
ESCAPE = 255

HEADER = struct.Struct("<qqqq")


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class Packing:
    """How sequences of ``words`` ids of ``bits`` bits lie in two limbs."""

    words: int
    bits: int

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= MOST_ID_BITS or self.words not in (2, 3):
            raise ValueError("two or three ids of up to 42 bits")

    @property
    def high_bits(self) -> int:
        return self.words * self.bits // 2

    @property
    def low_bits(self) -> int:
        return self.words * self.bits - self.high_bits

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        b, r = np.uint64(self.bits), self.low_bits
        first, *rest = (x.astype(np.uint64) for x in ids)
        if self.words == 2:
            return first, rest[0]
        second, third = rest
        over = np.uint64(r - self.bits)
        low = ((second << b) | third) & _mask(r)
        return (first << np.uint64(2 * self.bits - r)) | (second >> over), low

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        if self.words == 2:
            return [high.astype(np.int64), low.astype(np.int64)]
        r = self.low_bits
        over, rest = np.uint64(r - self.bits), np.uint64(2 * self.bits - r)
        second = ((high & _mask(2 * self.bits - r)) << over) | (low >> np.uint64(self.bits))
        return [(high >> rest).astype(np.int64), second.astype(np.int64), (low & _mask(self.bits)).astype(np.int64)]

    def permute(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = _mask(self.high_bits), _mask(self.low_bits)
        for turn in range(1, ROUNDS + 1):
            high = high ^ (mixed(low, 2 * turn) & up)
            low = low ^ (mixed(high, 2 * turn + 1) & down)
        return high, low

    def restore(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = _mask(self.high_bits), _mask(self.low_bits)
        for turn in range(ROUNDS, 0, -1):
            low = low ^ (mixed(high, 2 * turn + 1) & down)
            high = high ^ (mixed(low, 2 * turn) & up)
        return high, low


@dataclass
class Counts:
    """Distinct scrambled numbers in ascending order, and how often each was counted."""

    high: np.ndarray
    low: np.ndarray
    times: np.ndarray

    def slice(self, begin: int, end: int) -> Counts:
        return Counts(self.high[begin:end], self.low[begin:end], self.times[begin:end])


def count(packing: Packing, high: np.ndarray, low: np.ndarray, times: np.ndarray | None = None) -> Counts:
    """Counts of numbers in any order; ``times`` says how often each was seen, once each where it is not given."""

    if packing.words * packing.bits <= 64:
        r = np.uint64(packing.low_bits)
        whole = (high << r) | low
        if times is None:
            whole.sort()
            order = None
        else:
            order = np.argsort(whole, kind="stable")
            whole = whole[order]
        high, low = whole >> r, whole & _mask(packing.low_bits)
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
    fresh = np.ones(len(high), bool)
    fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    begins = np.flatnonzero(fresh)
    if times is None:
        sums = np.diff(np.append(begins, len(high)))
    else:
        sums = np.add.reduceat(times[order], begins) if len(begins) else times[:0]
    return Counts(high[begins], low[begins], sums.astype(np.int64))


def slices(packing: Packing, counts: Counts, bits: int) -> list[tuple[int, Counts]]:
    """The counts cut by the ``bits`` uppermost bits of their numbers; empty slices are left out."""

    of = counts.high >> np.uint64(packing.high_bits - bits)
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(of), 1), bool), of[1:] != of[:-1]]))
    return [(int(of[b]), counts.slice(b, e)) for b, e in zip(begins, [*begins[1:], len(of)])]


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The lower ``bits`` bits of each value in as many whole bytes as they need."""

    width = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values(data: memoryview, size: int, bits: int) -> np.ndarray:
    width = -(-bits // 8)
    whole = np.zeros((size, 8), np.uint8)
    whole[:, :width] = np.frombuffer(data, np.uint8, size * width).reshape(size, width)
    return whole.reshape(-1).view("<u8")


def encode(packing: Packing, counts: Counts, prefix_bits: int) -> bytes:
    """A filter of counts whose numbers agree in their ``prefix_bits`` uppermost bits.

    Occupied quotients and the last of each run are one bit each; remainders are whole; a count is one byte, or one
    byte and eight.
    """

    size = len(counts.high)
    free = packing.high_bits - prefix_bits
    quotient_bits = min(free, max(size - 1, 1).bit_length())
    rest = free - quotient_bits
    prefix = int(counts.high[0] >> np.uint64(free)) if size else 0
    within = counts.high & _mask(free)
    quotient = (within >> np.uint64(rest)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient] = True
    last = np.ones(size, bool)
    last[:-1] = quotient[1:] != quotient[:-1]
    small = np.minimum(counts.times, ESCAPE).astype(np.uint8)
    many = counts.times[counts.times >= ESCAPE].astype("<i8")
    return b"".join(
        [
            HEADER.pack(size, prefix, prefix_bits, quotient_bits),
            np.packbits(occupied).tobytes(),
            np.packbits(last).tobytes(),
            _planes(within & _mask(rest), rest),
            _planes(counts.low, packing.low_bits),
            small.tobytes(),
            many.tobytes(),
        ]
    )


def decode(packing: Packing, data: bytes) -> Counts:
    size, prefix, prefix_bits, quotient_bits = HEADER.unpack_from(data)
    view, at = memoryview(data), HEADER.size
    free = packing.high_bits - prefix_bits
    rest = free - quotient_bits

    def take(length: int) -> memoryview:
        nonlocal at
        at += length
        return view[at - length : at]

    occupied = np.unpackbits(np.frombuffer(take(-(-(1 << quotient_bits) // 8)), np.uint8), count=1 << quotient_bits)
    last = np.unpackbits(np.frombuffer(take(-(-size // 8)), np.uint8), count=size)
    run = np.cumsum(last) - last
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    remainder = _values(take(size * -(-rest // 8)), size, rest)
    low = _values(take(size * -(-packing.low_bits // 8)), size, packing.low_bits)
    times = np.frombuffer(take(size), np.uint8).astype(np.int64)
    times[times == ESCAPE] = np.frombuffer(view[at:], "<i8")
    high = (np.uint64(prefix) << np.uint64(free)) | (quotient << np.uint64(rest)) | remainder
    return Counts(high, low, times)


def merge(packing: Packing, filters: list[Counts]) -> Counts:
    """One sorted stream of several, counts of equal numbers added."""

    high, low, times = (np.concatenate([getattr(f, name) for f in filters]) for name in ("high", "low", "times"))
    return count(packing, high, low, times)
