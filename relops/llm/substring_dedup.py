"""Repeated word windows across documents, found level by level.

Windows repeated at one length alone are extended to twice that length. The first level looks at a quarter of the
window and only at places chosen by content: of every full window the quarter with the smallest hash, so equal full
windows choose equal quarters. A quarter that occurs in no other document ends there; a repeated one is doubled to
both sides (a full window that contains it contains one of its doubles), the repeated doubles are extended to the
full windows around them, and after that level no candidate is left to extend.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relops.columns import quote
from relops.llm import bytewise as B
from relops.llm.shards import SHARD_BYTES, Answer, Question, Round, Shard, converse, distinct_keys

WINDOW = 50


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Cut every word that lies in a window of ``window`` words which also starts in a document with a smaller id.

    Returns one row per row of ``docs``: the id, ``n_words``, ``n_removed``, ``spans`` (removed ranges of word
    numbers, the end excluded) and ``kept_text`` (the other words joined by one space). Words are what white space
    (ASCII) separates. A null or empty text has no words and keeps the empty text; a null id counts as larger than
    every other; rows with equal ids are no smaller than each other, so repeated rows stay unless a smaller id has
    the same words. Other columns of ``docs`` are not looked at. Windows are compared by 64-bit hashes.
    """

    if window < 4:
        raise ValueError("a window needs four words at least")
    levels = _Levels(window)
    schema = f"{quote(id_col)} long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"

    def conclude(shard: Shard, answer: Answer) -> pa.Table:
        words = _words(shard)
        starts = np.flatnonzero(levels.unpack(answer.state, words))
        _, place, least, _ = distinct_keys(levels.keys(words, window, starts), shard.ids[words.doc[starts]])
        hit = starts[answer.earlier[place] | (least[place] < shard.ids[words.doc[starts]])] if len(starts) else starts
        gone = B.cover(hit, hit + window, len(words.starts))
        return _result(shard, words, gone, id_col)

    rounds = [Round(levels.quarters, key_bytes=6), Round(levels.halves, key_bytes=6), Round(levels.windows)]
    return converse(docs, id_col, text_col, rounds, conclude, schema, 12_000, shard_bytes)


def _words(shard: Shard) -> B.Words:
    return B.words_by_piece(shard.data, shard.offsets, B.SPACED)


class _Levels:
    """The questions of each level; all are made again from the texts, only bits are remembered between them."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.quarter = -(-window // 4)
        self.half = min(2 * self.quarter, window)

    def anchors(self, words: B.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chosen quarters: where each begins, the first and last window that chose it, and its hash."""

        grams = B.gram_hashes(words.hashes, self.quarter)
        width = self.window - self.quarter + 1
        none = np.zeros(0, np.int64)
        if len(grams) < width:
            return none, none, none, grams[:0]
        starts = np.flatnonzero(words.whole(self.window))
        if not len(starts):
            return none, none, none, grams[:0]
        chosen = B.leftmost_minima(grams, width)[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
        begins = np.flatnonzero(fresh)
        ends = np.append(begins[1:], len(starts)) - 1
        at = chosen[begins].astype(np.int64)
        return at, starts[begins], starts[ends], grams[at]

    def quarters(self, shard: Shard, answer: Answer | None) -> Question:
        words = _words(shard)
        at, _, _, hashes = self.anchors(words)
        keys, _, least, most = distinct_keys(hashes, shard.ids[words.doc[at]])
        return Question(keys, least != most)

    def doubles(self, words: B.Words, at, first, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Doubled quarters to the right and to the left with the windows that hold them, where there are any."""

        right_first = np.maximum(first, at + self.half - self.window)
        left_last = np.minimum(last, at - (self.half - self.quarter))
        right, left = right_first <= last, left_last >= first
        return (
            np.concatenate([at[right], at[left] - (self.half - self.quarter)]),
            np.concatenate([right_first[right], first[left]]),
            np.concatenate([last[right], left_last[left]]),
        )

    def halves(self, shard: Shard, answer: Answer) -> Question:
        words = _words(shard)
        at, first, last, hashes = self.anchors(words)
        _, place, _, _ = distinct_keys(hashes, shard.ids[words.doc[at]])
        alive = answer.elsewhere[place] if len(at) else np.zeros(0, bool)
        begin, _, _ = self.doubles(words, at[alive], first[alive], last[alive])
        keys, _, least, most = distinct_keys(self.keys(words, self.half, begin), shard.ids[words.doc[begin]])
        return Question(keys, least != most, np.packbits(alive).tobytes())

    def windows(self, shard: Shard, answer: Answer) -> Question:
        words = _words(shard)
        at, first, last, _ = self.anchors(words)
        alive = np.unpackbits(np.frombuffer(answer.state, np.uint8), count=len(at)).astype(bool)
        begin, opens, closes = self.doubles(words, at[alive], first[alive], last[alive])
        _, place, _, _ = distinct_keys(self.keys(words, self.half, begin), shard.ids[words.doc[begin]])
        repeated = answer.elsewhere[place] if len(begin) else np.zeros(0, bool)
        marked = B.cover(opens[repeated], closes[repeated] + 1, len(words.starts))
        starts = np.flatnonzero(marked)
        keys, _, least, most = distinct_keys(self.keys(words, self.window, starts), shard.ids[words.doc[starts]])
        return Question(keys, least != most, np.packbits(marked).tobytes())

    @staticmethod
    def keys(words: B.Words, length: int, starts: np.ndarray) -> np.ndarray:
        return B.mixed(B.gram_hashes(words.hashes, length)[starts], length)

    @staticmethod
    def unpack(state: bytes, words: B.Words) -> np.ndarray:
        return np.unpackbits(np.frombuffer(state, np.uint8), count=len(words.starts)).astype(bool)


def _result(shard: Shard, words: B.Words, gone: np.ndarray, id_col: str) -> pa.Table:
    doc = words.doc
    kept = np.flatnonzero(~gone)
    joined = np.zeros(len(kept), bool)
    joined[:-1] = doc[kept[1:]] == doc[kept[:-1]]
    # A kept word with another after it in its document is followed by one of its separators, made a space.
    data = shard.data.copy()
    data[words.ends[kept[joined]]] = 0x20
    mask = B.cover(words.starts[kept], words.ends[kept] + joined, len(data))
    return pa.table(
        {
            id_col: pa.array(shard.ids, pa.int64(), mask=~shard.known),
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(B.per_document(gone, words.first), pa.int64()),
            "spans": B.run_lists(gone, words.first),
            "kept_text": B.masked_texts(data, mask, shard.offsets).cast(pa.string()),
        }
    )
