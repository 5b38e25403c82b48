"""Repeated byte strings across documents, by suffix arrays of shards merged by binary search.

A shard first finds out which of its bytes can matter at all: of every ``length``-byte string the 24-byte piece with
the smallest hash is chosen, and a string is a candidate only if its chosen piece occurs in another document. All
strings around one place of a piece are its context. A context that an earlier document has too is repeated as a
whole, and a piece that has the same context everywhere is settled by that. What is left are contexts that differ
around the same piece: over their bytes the shard builds a suffix array and the common prefixes of neighbours.
Suffixes that share ``length`` bytes are one string, which is sent once; buckets merge the shards' sorted runs and
look each run up by binary search, so every shard learns which of its strings an earlier shard holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relops.columns import quote
from relops.llm import bytewise as B
from relops.llm.shards import MANY, SHARD_BYTES, Answer, Question, Round, Shard, converse, distinct_keys
from relops.llm.suffix_arrays import common_prefixes, suffix_order

LENGTH = 50
PIECE = 24
# Below every id.
BEFORE_ALL = -(2**63)


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Cut every byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Returns one row per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed ranges of
    byte positions, the end excluded) and ``kept`` (the other bytes, as binary, since a cut may split a character).
    A null text is empty; a text shorter than ``length`` is kept; strings may overlap and never cross documents.
    A null id counts as larger than every other; rows with equal ids are no smaller than each other. Other columns
    are not looked at. Strings of different shards are compared by 64-bit hashes.
    """

    if length < PIECE + 2:
        raise ValueError(f"strings need {PIECE + 2} bytes at least")
    strings = _Strings(length)
    schema = f"{quote(id_col)} long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"

    def conclude(shard: Shard, answer: Answer) -> pa.Table:
        edges, whole_edges, foreign = _unpacked(answer.state, 3)
        starts, klass, keys, least = strings.classes(shard, edges, foreign)
        asked, place, _, _ = distinct_keys(keys, least)
        earlier = answer.earlier[place] if len(keys) else np.zeros(0, bool)
        own = shard.ids[strings.document(shard, starts)]
        hit = starts[earlier[klass] | (least[klass] < own)]
        repeated = np.flatnonzero(strings.marks(shard, whole_edges))
        hit = np.concatenate([hit[strings.marks(shard, edges)[hit]], repeated])
        gone = B.cover(hit, hit + length, len(shard.data))
        return _result(shard, gone, id_col)

    rounds = [Round(strings.pieces, key_bytes=5), Round(strings.contexts), Round(strings.whole)]
    return converse(docs, id_col, text_col, rounds, conclude, schema, 75_000, shard_bytes)


def _packed(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.astype("<i8").tobytes() for a in arrays)


def _unpacked(state: bytes, count: int) -> list[np.ndarray]:
    values = np.frombuffer(state, "<i8")
    return np.split(values[count:], np.cumsum(values[: count - 1]))


class _Strings:
    def __init__(self, length: int) -> None:
        self.length = length

    @staticmethod
    def document(shard: Shard, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(shard.offsets, at, "right") - 1

    def anchors(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chosen pieces: the first and last string that chose each, and its hash."""

        width = self.length - PIECE + 1
        out = []
        for begin, end in B.pieces(shard.offsets):
            base = shard.offsets[begin]
            data, offsets = shard.data[base : shard.offsets[end]], shard.offsets[begin : end + 1] - base
            hashes = B.gram_hashes(B.byte_values(data), PIECE)
            if len(hashes) < width:
                continue
            starts = np.flatnonzero(B.inside(offsets, self.length))
            if not len(starts):
                continue
            chosen = B.leftmost_minima(hashes, width)[starts]
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
            opens = np.flatnonzero(fresh)
            closes = np.append(opens[1:], len(starts)) - 1
            out.append((starts[opens] + base, starts[closes] + base, hashes[chosen[opens]]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def pieces(self, shard: Shard, answer: Answer | None) -> Question:
        first, _, hashes = self.anchors(shard)
        keys, _, least, most = distinct_keys(hashes, shard.ids[self.document(shard, first)])
        return Question(keys, least != most)

    def _contexts(self, shard: Shard, alive: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of all bytes of the strings that chose each living piece."""

        out = np.zeros(int(alive.sum()), np.uint64)
        begin_at, end_at = first[alive], last[alive] + self.length
        for begin, end in B.pieces(shard.offsets):
            base, stop = shard.offsets[begin], shard.offsets[end]
            some = slice(*np.searchsorted(begin_at, [base, stop]))
            out[some] = B.slice_hashes(B.byte_values(shard.data[base:stop]), begin_at[some] - base, end_at[some] - base)
        return out

    def contexts(self, shard: Shard, answer: Answer) -> Question:
        first, last, hashes = self.anchors(shard)
        _, place, _, _ = distinct_keys(hashes, first)
        alive = answer.elsewhere[place] if len(first) else np.zeros(0, bool)
        holders = answer.holders[place[alive]] if len(first) else np.zeros(0, np.uint8)
        names = self._contexts(shard, alive, first, last)
        keys, _, least, most = distinct_keys(names, shard.ids[self.document(shard, first[alive])])
        return Question(keys, least != most, np.packbits(alive).tobytes() + holders.astype(np.uint8).tobytes())

    def whole(self, shard: Shard, answer: Answer) -> Question:
        first, last, hashes = self.anchors(shard)
        raw = np.frombuffer(answer.state, np.uint8)
        bits = -(-len(first) // 8)
        alive = np.unpackbits(raw[:bits], count=len(first)).astype(bool)
        holders = raw[bits:]
        names = self._contexts(shard, alive, first, last)
        first, last, hashes = first[alive], last[alive], hashes[alive]
        ids = shard.ids[self.document(shard, first)]
        keys, place, least, _ = distinct_keys(names, ids)
        earlier = answer.earlier[place] if len(first) else np.zeros(0, bool)
        repeated = earlier | (least[place] < ids) if len(first) else earlier
        # Does the shard hold the piece in one context only, and all shards that hold the piece hold that context?
        _, piece, low, high = distinct_keys(hashes, place)
        one = (low == high)[piece] if len(first) else earlier
        shared = answer.holders[place] if len(first) else holders
        settled = one & (holders == shared) & (shared < MANY)
        asks = ~repeated & ~settled
        # Contexts that an earlier shard has still answer for other contexts of the piece in this shard.
        answers = np.zeros(len(first), bool)
        if len(first):
            answers[np.unique(place, return_index=True)[1]] = True
            answers &= earlier & ~one
        size = len(shard.data)
        asked = self.edges(B.cover(first[asks], last[asks] + 1, size))
        certain = self.edges(B.cover(first[repeated], last[repeated] + 1, size))
        foreign = self.edges(B.cover(first[answers], last[answers] + 1, size))
        _, _, keys, low = self.classes(shard, asked, foreign)
        keys, _, low, _ = distinct_keys(keys, low)
        return Question(keys, np.zeros(len(keys), bool), _packed(asked, certain, foreign))

    @staticmethod
    def edges(marked: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.diff(marked, prepend=False, append=False))

    @staticmethod
    def marks(shard: Shard, edges: np.ndarray) -> np.ndarray:
        return B.cover(edges[0::2], edges[1::2], len(shard.data))

    def classes(self, shard: Shard, edges: np.ndarray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidate starts, the class of equal strings each belongs to, and each class's key and smallest id.

        ``edges`` bound the starts asked for, ``foreign`` those whose strings are known to be in an earlier shard:
        they count as having an id below all others.
        """

        none = np.zeros(0, np.int64)
        if not len(edges):
            return none, none, np.zeros(0, np.uint64), none
        asked, known = self.marks(shard, edges), self.marks(shard, foreign)
        wanted = asked | known
        opens = self.edges(wanted)
        source = np.flatnonzero(B.cover(opens[0::2], opens[1::2] + self.length - 1, len(shard.data)))
        text = shard.data[source]
        order = suffix_order(text, self.length)
        order = order[wanted[source[order]]]
        fresh = common_prefixes(text, order, self.length) < self.length
        begins = np.flatnonzero(fresh)
        starts = source[order]
        ids = np.where(known[starts], BEFORE_ALL, shard.ids[self.document(shard, starts)])
        hashes = B.gram_hashes(B.byte_values(text), self.length)[order[begins]]
        return starts, np.cumsum(fresh) - 1, B.mixed(hashes, self.length), np.minimum.reduceat(ids, begins)


def _result(shard: Shard, gone: np.ndarray, id_col: str) -> pa.Table:
    return pa.table(
        {
            id_col: pa.array(shard.ids, pa.int64(), mask=~shard.known),
            "n_bytes": pa.array(np.diff(shard.offsets), pa.int64()),
            "n_removed": pa.array(B.per_document(gone, shard.offsets), pa.int64()),
            "spans": B.run_lists(gone, shard.offsets),
            "kept": B.masked_texts(shard.data, ~gone, shard.offsets).cast(pa.binary()),
        }
    )
