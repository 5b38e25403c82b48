"""Benchmark phrases in documents, by an FM-index per shard of documents.

A shard's words are numbered by the benchmark's vocabulary. Words outside it end a run, and runs shorter than the
shortest phrase cannot hold one; what is left is indexed. All phrases are searched backwards together, occurrences
are located from sampled suffix positions, and their word ranges are merged into spans.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relops.columns import col
from relops.llm import bytewise as B
from relops.llm.fm_index import FMIndex
from relops.llm.rowwise import annotate

WINDOW = 13
SHARD_BYTES = 4 << 20
# Benchmark text that is held by every task at once; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 8 << 20

FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"), ("spans", "array<struct<start:bigint,end:bigint>>")]


def mark_benchmark(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Where phrases of benchmark items stand in documents.

    A phrase is ``window`` consecutive words of an item, or all words of a shorter one; words are runs of digits,
    letters and non-ASCII characters after A-Z are lower-cased. Returns for every row of ``docs`` the columns
    ``keep`` and ``n_words``, ``n_hit`` (words inside any occurrence), ``items`` (ids of the items with phrases
    there, as distinct strings in string order) and ``spans`` (merged ranges of hit words, the end excluded). Null
    and empty texts have no words, items without words have no phrase, an item with a null id is named by the empty
    string, and items with equal ids are one. A kept column named like a new one is replaced by it.
    """

    size = items.agg(F.coalesce(F.sum(F.octet_length(col(item_text_col))), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    named = items.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), col(item_text_col).cast("string").alias("text"))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    found = None
    for number in range(blocks):
        rows = (named if blocks == 1 else named.filter(block == number)).toArrow()
        phrases = docs.sparkSession.sparkContext.broadcast(_Phrases(rows, window))
        compute = _searcher(phrases)
        if found is None:
            carried = [text_col] if blocks > 1 and text_col not in keep else []
            found = annotate(docs, text_col, compute, FIELDS, [*keep, *carried])
        else:
            before = found.withColumnsRenamed({"items": "__relops_items", "spans": "__relops_spans"})
            found = annotate(before, text_col, compute, FIELDS, [c for c in before.columns if c not in ("n_words", "n_hit")])
            found = found.withColumn("items", F.array_sort(F.array_union("__relops_items", "items")))
            found = found.withColumn("spans", _merged(F.array_sort(F.concat("__relops_spans", "spans")))).drop("__relops_items", "__relops_spans")
            found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    return found.select(*[col(c) for c in keep if c not in dict(FIELDS)], *[name for name, _ in FIELDS])


def contaminated(share: int = 20) -> F.Column:
    """The rule for whole documents: at least one in ``share`` of its words is hit."""

    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def _merged(ordered):
    """Overlapping or touching ranges of a sorted list made one."""

    kind = "array<struct<start:bigint,end:bigint>>"

    def add(done, one):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= one["start"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], one["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(ordered, F.array().cast(kind), add)


class _Phrases:
    """Distinct phrases by length, as rows of symbols, with the items of each, and the vocabulary they use."""

    def __init__(self, rows: pa.Table, window: int) -> None:
        data, offsets = B.text_bytes(rows["text"])
        words = B.words_by_piece(data, offsets, B.ALNUM, B.LOWER)
        self.vocabulary = np.unique(words.hashes)
        # 0 ends the text and 1 separates runs, so words begin at 2.
        symbols = np.searchsorted(self.vocabulary, words.hashes) + 2
        names = rows["item"].to_pylist()
        found: dict[int, dict[tuple, set]] = {}
        for number, name in enumerate(names):
            begin, end = int(words.first[number]), int(words.first[number + 1])
            length = min(window, end - begin)
            for at in range(begin, end - length + 1) if length else ():
                found.setdefault(length, {}).setdefault(tuple(symbols[at : at + length].tolist()), set()).add(name)
        self.names = sorted(set(names))
        place = {name: i for i, name in enumerate(self.names)}
        self.shortest = min(found, default=0)
        self.groups = []
        for length, phrases in found.items():
            owners = [sorted(place[n] for n in holders) for holders in phrases.values()]
            first = np.concatenate([[0], np.cumsum([len(o) for o in owners])])
            self.groups.append((length, np.array(list(phrases), np.int64), np.array([x for o in owners for x in o], np.int64), first))


def _searcher(shared):
    def compute(texts: pa.Array) -> list[pa.Array]:
        phrases = shared.value
        data, offsets = B.text_bytes(texts)
        parts = [_search(phrases, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in B.pieces(offsets, SHARD_BYTES)]
        if not parts:
            parts = [_search(phrases, data, offsets)]
        return [pa.concat_arrays(column) for column in zip(*parts)]

    return compute


def _search(phrases: _Phrases, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    words = B.words_by_piece(data, offsets, B.ALNUM, B.LOWER)
    hit = np.zeros(len(words.starts), bool)
    pairs = np.zeros(0, np.int64)
    if len(words.starts) and len(phrases.vocabulary):
        at = np.searchsorted(phrases.vocabulary, words.hashes)
        at[at == len(phrases.vocabulary)] = 0
        known = phrases.vocabulary[at] == words.hashes
        opens, closes, _ = B.cut(known.view(np.uint8), words.first, np.arange(256) == 1)
        long = closes - opens >= phrases.shortest
        opens, closes = opens[long], closes[long]
        if len(opens):
            hit, pairs = _occurrences(phrases, words, at + 2, opens, closes)
    docs, items = np.divmod(np.unique(pairs), max(len(phrases.names), 1))
    names = pa.array(phrases.names, pa.string()).take(pa.array(items))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(offsets) - 1))])
    return [
        pa.array(words.counts, pa.int64()),
        pa.array(B.per_document(hit, words.first), pa.int64()),
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), names),
        B.run_lists(hit, words.first),
    ]


def _occurrences(phrases: _Phrases, words: B.Words, symbols: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hit words, and (document, item) pairs as one number each."""

    lengths = closes - opens + 1
    first = np.cumsum(lengths) - lengths
    source = np.arange(lengths.sum()) - np.repeat(first - opens, lengths)
    text = symbols[np.minimum(source, len(symbols) - 1)]
    text[first + lengths - 1] = 1
    index = FMIndex(text, len(phrases.vocabulary) + 2)
    edges = np.zeros(len(symbols) + 1, np.int64)
    pairs = []
    for length, patterns, owners, owner_first in phrases.groups:
        which, low, high = index.search(patterns)
        if not len(which):
            continue
        times = high - low
        rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - low, times)
        at = source[index.locate(rows)]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + length, -1)
        # Every item of a phrase, for every place the phrase stands.
        phrase = np.repeat(which, times)
        doc = np.searchsorted(words.first, at, "right") - 1
        seen = np.unique(doc * len(patterns) + phrase)
        doc, phrase = np.divmod(seen, len(patterns))
        count = owner_first[phrase + 1] - owner_first[phrase]
        each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - owner_first[phrase], count)
        pairs.append(np.repeat(doc, count) * len(phrases.names) + owners[each])
    return np.cumsum(edges[:-1]) > 0, np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
