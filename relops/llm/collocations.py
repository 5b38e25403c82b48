"""Collocations of two and three words per language, counted in quotient filters that are merged across shards.

1. Each task cuts its texts into shards, runs of a few MiB, and writes a shard as its distinct words and a stream of
   word numbers. Texts are read and cut into words once and never shuffled.
2. Words are counted over all shards; only those that are frequent enough to stand in a candidate get a global id.
3. A shard's words are joined with the ids, its stream is recoded, and its two- and three-word sequences are counted
   in quotient filters, cut into slices by the uppermost bits of the scrambled number.
4. Filters of one slice are merged, a fixed number of shards a round, with finer slices every round: so a group never
   holds more than a fixed share of a few shards. Scrambling spreads frequent sequences evenly over the slices.
5. What is frequent enough is scored by joins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relops.columns import col
from relops.llm import bytewise as B
from relops.llm.counting_filters import MOST_ID_BITS, Counts, Packing, count, decode, encode, merge, slices
from relops.staging import stage, with_row_index

LEAST = 10
TOP = 2000
# A candidate goes where a longer one holds this share of its places, in percent.
INSIDE_PERCENT = 50
UNKNOWN = "und"
SCORE_UNIT = 1_000_000
# Text of one shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
# Filters merged at once, as bits: as many slices as shards of a group.
FAN_BITS = 8

SHARD = "shard long, langs array<string>, words array<string>, counts array<long>, stream binary"
FILTER = "n int, slice long, shard long, filter binary"
GRAMS = "n int, w1 long, w2 long, w3 long, f long"

# Words of a piece are cut at these; the first two separate words only, the others pieces too.
BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
KEPT = np.ones(256, bool)
KEPT[list(BLANKS + BREAKS)] = False
BREAK = np.zeros(256, bool)
BREAK[list(BREAKS)] = True


def mine_collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    least: int = LEAST,
    top: int = TOP,
    inside_percent: int = INSIDE_PERCENT,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Each language's first ``top`` collocations: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased A-Z, cut at ``.,;:!?`` and line ends into pieces and those at blanks and tabs into words; a
    null text has none, a null language is ``und``. ``n`` counts a language's words, f(phrase) its places inside
    pieces. Candidates are phrases of two or three words with ``a`` = f of ``least`` or more. Cut after its first k
    words, l and r are the counts of the two parts and floor(1000000 * a * a / (l * r)) is the score; the lowest cut
    counts, the smallest k of equal ones. A candidate inside a longer one with at least ``inside_percent`` of its
    places goes. Order: score and a descending, then the phrase's bytes. Equal rows count as often as they stand
    there; the columns ``text_col`` and ``lang_col`` alone are looked at; an empty table gives no rows.
    """

    if least < 1:
        raise ValueError("a candidate stands somewhere at least once")
    texts = docs.select(col(text_col).cast("string").alias("text"), F.coalesce(col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    shards = stage(texts.mapInArrow(_encoder(shard_bytes), SHARD), "shards")
    listed = shards.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "one"))
    listed = listed.select("shard", "place", F.col("one.langs").alias("lang"), F.col("one.words").alias("word"), F.col("one.counts").alias("times"))
    counted = stage(listed.groupBy("lang", "word").agg(F.sum("times").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    known = stage(with_row_index(counted.filter(F.col("f") >= least), ["lang", "word"], "id"), "ids")
    found = stage(_frequent(shards, listed, known, least), "grams")
    return _ranked(_scored(found, known, inside_percent), totals, top)


def _frequent(shards: DataFrame, listed: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Two- and three-word sequences of global ids (``w3`` null for two) that occur ``least`` times or more."""

    number, size = shards.count(), known.count()
    bits = max(size.bit_length(), 1)
    if bits > MOST_ID_BITS:
        raise ValueError("more frequent words than ids")
    named = listed.join(known.select("lang", "word", "id"), ["lang", "word"]).select("shard", "place", "id")
    named = named.select(F.col("shard").alias("of"), "place", "id")
    streams = shards.select("shard", F.size("words").alias("size"), "stream")
    rounds = max(1, math.ceil(math.log2(max(number, 2)) / FAN_BITS))
    # The first round's slices: no more than there are shards in a group.
    fan = min(FAN_BITS, max(1, math.ceil(math.log2(max(number, 2)))))
    filters = streams.groupBy("shard").cogroup(named.groupBy("of")).applyInArrow(_counter(bits, fan), FILTER)
    for turn in range(1, rounds + 1):
        last = turn == rounds
        groups = 1 << max(0, FAN_BITS * (rounds - turn))
        group = F.pmod(F.xxhash64("shard"), F.lit(groups))
        dealt = filters.select("n", "slice", group.alias("shard"), "filter").groupBy("n", "slice", "shard")
        if last:
            return dealt.applyInArrow(_merger(bits, 0, least), GRAMS)
        filters = stage(dealt.applyInArrow(_merger(bits, FAN_BITS * (turn + 1), None), FILTER), "filters")


def _scored(found: DataFrame, known: DataFrame, inside_percent: int) -> DataFrame:
    """Candidates that stay: ``lang``, ``phrase``, ``a``, ``l``, ``r`` and ``score``."""

    def word(i: int) -> DataFrame:
        return known.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))

    two = found.filter("n = 2").select("w1", "w2", F.col("f").alias("a"))
    three = found.filter("n = 3").select("w1", "w2", "w3", F.col("f").alias("a"))
    longer = three.select("w1", "w2", "a").union(three.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longest"))
    pairs = two.join(longer, ["w1", "w2"], "left").filter(F.col("longest").isNull() | (F.lit(100) * F.col("longest") < F.lit(inside_percent) * F.col("a")))
    pairs = pairs.join(word(1), "w1").join(word(2), "w2")
    pairs = pairs.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.array(_cut(1, F.col("f1"), F.col("f2"))).alias("cuts"))
    triples = three.join(two.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"])
    triples = triples.join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    triples = triples.join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    cuts = F.array(_cut(1, F.col("f1"), F.col("f23")), _cut(2, F.col("f12"), F.col("f3")))
    triples = triples.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", cuts.alias("cuts"))
    lowest = F.array_min("cuts")
    return pairs.union(triples).select("lang", "phrase", "a", lowest["l"].alias("l"), lowest["r"].alias("r"), lowest["score"].alias("score"))


def _cut(k: int, left: Column, right: Column) -> Column:
    """Score of one cut, exact: the products have up to 38 digits."""

    whole = lambda c: c.cast("decimal(16,0)")
    upper = (whole(F.col("a")) * whole(F.col("a"))).cast("decimal(31,0)") * F.lit(SCORE_UNIT).cast("decimal(7,0)")
    score = F.call_function("div", upper, whole(left) * whole(right)).cast("long")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def _ranked(scored: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _encoder(shard_bytes: int):
    """Runs of a task's texts as shards: distinct words by language, their counts, and the words as numbers.

    In the stream a word is its place in the list plus one, and 0 ends a piece.
    """

    def shard(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        texts = pa.Table.from_batches(batches)
        langs, words, counts, streams, known = [], [], [], [], 0
        for lang in texts["lang"].unique().to_pylist():
            some = texts["text"].filter(pc.equal(texts["lang"], lang))
            found, times, stream = _numbered(some)
            langs += [lang] * len(found)
            words.append(found)
            counts.append(times)
            streams.append(np.where(stream > 0, stream + known, 0).astype(np.int32))
            known += len(found)
        one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                one(pa.array(langs, pa.string())),
                one(pa.concat_arrays(words)),
                one(pa.array(np.concatenate(counts), pa.int64())),
                pa.array([np.concatenate(streams).tobytes()], pa.binary()),
            ],
            ["shard", "langs", "words", "counts", "stream"],
        )

    def encode_texts(batches):
        # One job writes the shards, so a partition and a place in it name each.
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0)).astype(np.int64)
            upto, begin = np.cumsum(sizes), 0
            while begin < batch.num_rows:
                before = int(upto[begin - 1]) if begin else 0
                end = max(begin + (not held), int(np.searchsorted(upto, before + shard_bytes - size, "right")))
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
                    size += int(upto[end - 1]) - before
                if end < batch.num_rows:
                    yield shard(held, number)
                    held, size, number = [], 0, number + 1
                begin = end
        if held:
            yield shard(held, number)

    return encode_texts


def _numbered(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts of one language, how often each stands there, and the stream of their numbers."""

    data, offsets = B.text_bytes(texts)
    data = B.LOWER[data]
    starts, ends, first = B.cut(data, offsets, KEPT)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[KEPT[data]]))
    numbers = spelled.dictionary_encode()
    place = numbers.indices.to_numpy().astype(np.int64)
    # A word opens a piece where a break, or the edge of a document, lies before it.
    breaks = np.flatnonzero(BREAK[data])
    opens = np.zeros(len(starts), bool)
    opens[1:] = np.searchsorted(breaks, starts[1:]) > np.searchsorted(breaks, ends[:-1])
    opens[first[:-1][first[:-1] < len(starts)]] = True
    stream = np.zeros(len(starts) + int(opens.sum()), np.int64)
    stream[np.arange(len(starts)) + np.cumsum(opens)] = place + 1
    return numbers.dictionary.cast(pa.string()), np.bincount(place, minlength=len(numbers.dictionary)), stream


def _counter(bits: int, fan: int):
    """Filters of one shard's sequences, by length and slice."""

    def work(streams: pa.Table, named: pa.Table) -> pa.Table:
        rows = []
        for shard, size, stream in zip(*(streams[c].to_pylist() for c in ("shard", "size", "stream"))):
            ids = np.zeros(size + 1, np.int64)
            # 0 stands for a rare word as for the end of a piece: neither is part of a candidate.
            ids[named["place"].to_numpy() + 1] = named["id"].to_numpy() + 1
            ids = ids[np.frombuffer(stream, np.int32)]
            set_ = ids > 0
            for n in (2, 3):
                if len(ids) < n:
                    continue
                whole = set_[: len(ids) - n + 1].copy()
                for i in range(1, n):
                    whole &= set_[i : len(ids) - n + 1 + i]
                at = np.flatnonzero(whole)
                packing = Packing(n, bits)
                counts = count(packing, *packing.permute(*packing.pack([ids[at + i] - 1 for i in range(n)])))
                rows += _sliced(packing, counts, n, fan, shard)
        return _filter_table(rows)

    return work


def _sliced(packing: Packing, counts: Counts, n: int, bits: int, shard: int) -> list[tuple]:
    bits = min(bits, packing.high_bits)
    return [(n, of, shard, encode(packing, part, bits)) for of, part in slices(packing, counts, bits)]


def _filter_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table({name: pa.array(column, kind) for name, column, kind in zip(("n", "slice", "shard", "filter"), columns, kinds)})


def _merger(bits: int, next_bits: int, least: int | None):
    """The merged filter of one slice, cut into finer slices; with ``least`` the sequences counted that often instead."""

    def work(filters: pa.Table) -> pa.Table:
        n, of, shard = (filters[c][0].as_py() for c in ("n", "slice", "shard"))
        packing = Packing(n, bits)
        merged = merge(packing, [decode(packing, one.as_py()) for one in filters["filter"]])
        if least is None:
            return _filter_table(_sliced(packing, merged, n, next_bits, shard))
        often = np.flatnonzero(merged.times >= least)
        words = packing.unpack(*packing.restore(merged.high[often], merged.low[often]))
        third = pa.array(words[2]) if n == 3 else pa.nulls(len(often), pa.int64())
        return pa.table({"n": pa.array(np.full(len(often), n, np.int32)), "w1": words[0], "w2": words[1], "w3": third, "f": merged.times[often]})

    return work
