"""Suffix arrays of byte strings by prefix doubling in numpy, and common prefixes of neighbouring suffixes."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte string in ascending order of their first ``depth`` bytes at least."""

    return refined_order(_eight_bytes(text), 8, depth)


def refined_order(keys: np.ndarray, reach: int, depth: int) -> np.ndarray:
    """Suffixes in ascending order of their first ``depth`` symbols at least; ``keys`` orders them by ``reach``.

    Larsson and Sadakane's refinement: each round sorts the groups that are still tied by the ranks as far on as
    the order reaches, and leaves groups of one alone, so settled suffixes cost nothing more.
    """

    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    first = np.ones(n + 1, bool)
    first[1:n] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0))
    rank[n] = -1
    while reach < depth:
        tied = np.flatnonzero(~(first[:n] & first[1:]))
        if not len(tied):
            break
        items = order[tied]
        pairs = rank[items] * (n + 2) + rank[np.minimum(items + reach, n)] + 1
        by = np.argsort(pairs)
        order[tied] = items[by]
        pairs = pairs[by]
        begins = np.ones(len(tied), bool)
        begins[1:] = pairs[1:] != pairs[:-1]
        first[tied] = begins
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(begins, np.arange(len(tied)), 0))]
        reach *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in ``order`` the length of its common prefix with the one before, counted up to ``depth``.

    The table that Kasai's walk fills; that walk goes position by position, so here all pairs advance together,
    eight bytes at a time, and a pair drops out where it differs.
    """

    keys = _eight_bytes(np.concatenate([text, np.zeros(depth + 8, np.uint8)]))
    shared = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    left, right = order[:-1], order[1:]
    for at in range(0, depth, 8):
        differing = keys[left + at] ^ keys[right + at]
        same = differing == 0
        # The highest differing bit tells how many leading bytes agree; float64 keeps its exponent exactly enough.
        low = differing[~same]
        top = np.where(low >> np.uint64(32) > 0, low >> np.uint64(32), low).astype(np.float64)
        bits = np.where(low >> np.uint64(32) > 0, 32, 0) + np.frexp(top)[1]
        shared[alive[~same]] += (64 - bits) // 8
        alive, left, right = alive[same], left[same], right[same]
        shared[alive] += 8
        if not len(alive):
            break
    return np.minimum(shared, depth)


def _eight_bytes(text: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64)
