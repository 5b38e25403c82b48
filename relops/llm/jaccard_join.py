"""Self-join of texts on the Jaccard similarity of their word shingles, through a token-group matrix.

Equal shingle sets are one class, and classes are joined. Tokens have one global order, rare ones first, so two
similar sets share a few of the first tokens of each (the prefix filter), and where the first shared token stands
bounds their overlap. Similar classes are put into groups: for each prefix token all its classes are compared with
two pivots only, and verified links make the groups. The token-group matrix then tells for each token which groups
hold it; a class asks only groups other than its own that share enough of its prefix tokens, the first in a place
that leaves enough overlap, its overlap with the token union of a block of the group is bounded, and only blocks that can still
reach the threshold are opened and their members compared. No link between classes of different groups is lost, and
inside a group nothing is left to find out, as its members are linked already.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relops.columns import col
from relops.llm import bytewise as B
from relops.llm.components import connected
from relops.staging import stage

SHINGLE = 3
PERCENT = 90
# Cells of the table of shingle frequencies, and of the bitmap of wanted ids: a fixed size, whatever the corpus.
CELL_BITS = 23
SLICE_BITS = 16
# Prefixes are long enough that similar sets share this many of their tokens, or all that they need to share.
SHARED = 4
# Members whose token union is stored together.
BLOCK = 64
# Classes compared with a copy of a pivot's text.
PIVOT_PAIRS = 256

SIGNATURE = "id long, class long, n long, prefix array<long>"


def link_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Component of each document under links of Jaccard similarity ``percent`` / 100 or more.

    Returns one row per row of ``docs``: the id, ``n_shingles`` (distinct shingles of ``shingle`` words, lower-cased
    A-Z, cut at ASCII white space; a shorter text is one shingle) and ``component_id``, the smallest id reachable.
    A text without words, or a null, has no shingles and is linked with nothing: its component is its own id. Rows
    with equal texts are linked, whatever their ids; rows with a null id take part, and a component of them alone
    has a null id. Other columns are not looked at. Shingles are compared by 64-bit hashes.
    """

    ident = col(id_col).cast("long").alias("id")
    source = docs.select(ident, col(text_col).cast("string").alias("text"))
    order = _frequencies(source, shingle)
    shared = source.sparkSession.sparkContext.broadcast(order)
    signatures = stage(source.mapInArrow(_signer(shingle, percent, shared), SIGNATURE), "signatures")
    classes = (
        signatures.filter("n > 0").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n", "prefix")).alias("first"))
    ).select("class", "first.prefix")
    facts = signatures.filter("n > 0").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n")).alias("first"))
    facts = facts.select(F.col("class").alias("known"), "first.id", "first.n")
    links = _links(_lists(classes, facts, percent), source, shingle, percent)
    labels = connected(links).withColumnRenamed("vertex", "class")
    # Links end at classes; a component's id is the smallest of all its documents.
    placed = signatures.select("id", "class", "n").join(labels, "class", "left")
    placed = placed.withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "class")))
    least = placed.filter("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    alone = placed.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    joined = placed.filter("n > 0").join(least, placed["component"].eqNullSafe(least["component"])).select("id", "n", "component_id")
    return joined.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def overlap_needed(one: Column, other: Column, percent: int) -> Column:
    """Smallest overlap of two sets of these sizes that reaches the similarity: 100 * o >= percent * (a + b - o)."""

    return F.ceil((F.lit(percent) * (one + other)) / F.lit(100 + percent))


def least_shared(size: Column, percent: int) -> Column:
    """Tokens that a set's prefix shares with that of every set similar to it."""

    return F.least(F.lit(SHARED), F.ceil(size * percent / 100))


def _lists(classes: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Prefix tokens that several classes hold, of classes with as many of them as any similar pair shares.

    A class is one row and its prefix tokens are distinct, so a token counted once is held by one class.
    """

    places = classes.select("class", F.posexplode("prefix").alias("place", "token"))
    shared = places.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(F.col("token").alias("key"))
    found = places.join(shared, F.col("token").eqNullSafe(F.col("key"))).select("class", "token", "place")
    held = found.groupBy("class").agg(F.collect_list(F.struct("token", "place")).alias("held"))
    held = held.join(facts, held["class"] == facts["known"]).filter(F.size("held") >= least_shared(F.col("n"), percent))
    return stage(held.select("class", "id", "n", F.explode("held").alias("one")).select("class", "id", "n", "one.token", "one.place"), "lists")


def _links(listed: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect every pair of classes which the threshold connects."""

    # Groups: every class of a list against two pivots of it.
    whole = F.struct("class", "id", "n", "place")
    central = F.min_by(whole, F.struct(F.col("place") / F.col("n"), "class"))
    pivots = listed.groupBy(F.col("token").alias("key")).agg(F.array_distinct(F.array(F.min(whole), central)).alias("pivots"))
    near = listed.join(pivots, F.col("token").eqNullSafe(F.col("key"))).select("class", "id", "n", "place", F.explode("pivots").alias("pivot"))
    near = near.select(
        "class", "id", "n", "place", F.col("pivot.class").alias("other"), F.col("pivot.id").alias("other_id"), F.col("pivot.n").alias("m"), F.col("pivot.place").alias("spot")
    )
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("spot"))
    # The smaller of two similar sets is at least the threshold's share of the larger.
    alike = (F.col("m") * 100 >= F.col("n") * percent) & (F.col("m") * percent <= F.col("n") * 100)
    pairs = near.filter((F.col("class") != F.col("other")) & alike).groupBy("class", "id", "n", "other", "other_id", "m")
    pairs = pairs.agg(F.max(left).alias("left"), F.count(F.lit(1)).alias("seen"))
    # A pivot is not listed for every shared token, so two are enough here; what this misses is asked for below.
    enough = F.least(F.lit(2), least_shared(F.col("n"), percent))
    pairs = pairs.filter((F.col("left") >= overlap_needed(F.col("n"), F.col("m"), percent)) & (F.col("seen") >= enough))
    pairs = stage(pairs.select("class", "id", "n", "other", "other_id", "m"), "pairs")
    stars = _verified(pairs, source, shingle, percent)

    groups = connected(stars)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    grouped = groups.join(sizes, "component").select(F.col("vertex").alias("member"), F.col("component").alias("group"), "size")
    listed = listed.join(grouped, listed["class"] == grouped["member"], "left").select(
        "token", "class", "id", "n", "place", F.coalesce("group", "class").alias("group"), F.coalesce("size", F.lit(1)).alias("size")
    )
    # The matrix: for each token the groups that hold it, with what bounds the overlap with any of their members.
    block = F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / BLOCK)).alias("block")
    listed = stage(listed.select("*", block), "grouped")
    matrix = listed.groupBy("token", "group", "block").agg(
        F.first("size").alias("their_size"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("rest")
    )
    matrix = matrix.select(F.col("token").alias("key"), F.col("group").alias("their"), F.col("block").alias("their_block"), "their_size", "least", "most", "rest")
    asks = listed.join(matrix, listed["token"].eqNullSafe(matrix["key"]) & (F.struct("size", "group") < F.struct("their_size", "their")))
    mine = F.col("n")
    asks = asks.filter((F.col("most") * 100 >= mine * percent) & (F.col("least") * percent <= mine * 100))
    # At the first of the tokens that a similar pair must share the rest leaves room for all the overlap needed, at the
    # next for all but one, and so on: what leaves less room cannot be one of them. So a token that many unlike classes
    # hold, late in their order, gives no row.
    enough = overlap_needed(mine, F.greatest("least", F.ceil(mine * percent / 100)), percent)
    asks = asks.filter(F.least(mine - F.col("place"), F.col("rest")) > enough - least_shared(mine, percent))
    asks = asks.groupBy("class", "id", "n", "their", "their_block").agg(
        F.max(F.least(mine - F.col("place"), F.col("rest"))).alias("left"), F.min("least").alias("least"), F.count(F.lit(1)).alias("seen")
    )
    enough = overlap_needed(mine, F.greatest("least", F.ceil(mine * percent / 100)), percent)
    asks = asks.filter((F.col("left") >= enough) & (F.col("seen") >= least_shared(mine, percent)))
    asks = stage(asks.select("class", "id", "n", "their", "their_block"), "asks")
    return stage(stars.union(_opened(asks, listed, source, shingle, percent)), "links")


def _sets(ids: DataFrame, source: DataFrame, shingle: int) -> DataFrame:
    """Shingle sets of some classes, made anew from one text of each: columns ``class`` and ``tokens``."""

    wanted = stage(ids.select(F.col("class").alias("wanted"), F.col("id").alias("wanted_id")).distinct(), "wanted")
    likely = source.mapInArrow(_likely(_bitmap(wanted)), "id long, text string")
    texts = likely.join(wanted, likely["id"].eqNullSafe(wanted["wanted_id"])).select("id", "text", "wanted")
    made = texts.mapInArrow(_set_maker(shingle), "class long, wanted long, tokens array<long>")
    return stage(made.filter("class = wanted").select("class", "tokens").dropDuplicates(["class"]), "sets")


def _verified(pairs: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (class, other) that reach the threshold, as links. One text of each class is moved: it is smaller than its set."""

    wanted = pairs.select(F.col("id").alias("wanted_id")).union(pairs.select("other_id")).distinct()
    likely = source.mapInArrow(_likely(_bitmap(wanted)), "id long, text string").mapInArrow(_namer(shingle), "class long, text string")
    # One shuffle by class serves both sides. A pivot that many classes are compared with is joined in so many parts.
    texts = likely.dropDuplicates(["class"])
    parts = pairs.groupBy(F.col("other").alias("pivot")).agg(F.ceil(F.count(F.lit(1)) / PIVOT_PAIRS).alias("parts"))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).alias("part")
    dealt = pairs.join(parts, pairs["other"].eqNullSafe(parts["pivot"])).select("class", "other", part)
    one = texts.select(F.col("class").alias("a"), F.col("text").alias("one"))
    two = texts.join(parts, texts["class"] == parts["pivot"]).select(
        F.col("pivot").alias("b"), F.col("text").alias("two"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("its_part")
    )
    full = dealt.join(one, dealt["class"] == one["a"]).select("a", "other", "part", "one")
    full = full.join(two, (full["other"] == two["b"]) & (full["part"] == two["its_part"])).select("a", "b", "one", "two")
    return stage(full.mapInArrow(_pair_checker(shingle, percent), "a long, b long"), "stars")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("class").alias("one"), F.col("tokens").alias("one_tokens"))
    two = sets.select(F.col("class").alias("two"), F.col("tokens").alias("two_tokens"))
    full = pairs.join(one, pairs["class"] == one["one"]).join(two, pairs["other"] == two["two"])
    overlap = F.size(F.array_intersect("one_tokens", "two_tokens"))
    union = F.size("one_tokens") + F.size("two_tokens") - overlap
    return full.filter(overlap * 100 >= union * percent).select(F.col("class").alias("a"), F.col("other").alias("b"))


def _opened(asks: DataFrame, listed: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Ask blocks by their token unions, open those that can hold a partner, and compare with their members."""

    wanted = asks.select(F.col("their").alias("group"), F.col("their_block").alias("block")).distinct()
    members = listed.select("class", "id", "n", "group", "block").distinct().join(wanted, ["group", "block"], "left_semi")
    members = stage(members, "members")
    sets = _sets(asks.select("class", "id").union(members.select("class", "id")), source, shingle)
    unions = (
        members.join(sets, "class")
        .groupBy("group", "block")
        .agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
        .select(F.col("group").alias("their"), F.col("block").alias("their_block"), "union")
    )
    own = sets.withColumnRenamed("tokens", "own")
    bounded = asks.join(own, "class").join(unions, ["their", "their_block"])
    bounded = bounded.filter(F.size(F.array_intersect("own", "union")) * 100 >= F.col("n") * percent)
    bounded = stage(bounded.select("class", "n", "their", "their_block"), "bounded")
    inside = members.select(F.col("class").alias("other"), F.col("n").alias("m"), F.col("group").alias("their"), F.col("block").alias("their_block"))
    pairs = bounded.join(inside, ["their", "their_block"])
    pairs = pairs.filter((F.col("m") * 100 >= F.col("n") * percent) & (F.col("m") * percent <= F.col("n") * 100))
    return _compared(pairs.select("class", "other"), sets, percent)


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Piece by piece: its first row, and document and hash of every shingle (of whole short texts too), not distinct."""

    data, offsets = B.text_bytes(column)
    for begin, end in B.pieces(offsets):
        at = offsets[begin]
        words = B.words_of(B.LOWER[data[at : offsets[end]]], offsets[begin : end + 1] - at, B.SPACED)
        hashes, doc = B.gram_hashes(words.hashes, shingle), words.doc
        fits = np.flatnonzero(words.whole(shingle))
        short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
        whole = B.slice_hashes(words.hashes, words.first[short], words.first[short + 1])
        yield begin, end, np.concatenate([doc[fits], short]), np.concatenate([hashes[fits], B.mixed(whole, 11)])


def _distinct(doc: np.ndarray, hashes: np.ndarray, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, in the global order if one is given."""

    keys = (hashes, doc) if order is None else (hashes, order[hashes >> np.uint64(64 - CELL_BITS)], doc)
    by = np.lexsort(keys)
    doc, hashes = doc[by], hashes[by]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[fresh], hashes[fresh]


def _class(doc: np.ndarray, hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each document's set and a 64-bit name for the set."""

    n = np.bincount(doc, minlength=count)
    first = np.concatenate([[0], np.cumsum(n)])
    names = []
    for seed in (1, 2):
        sums = np.zeros(len(doc) + 1, np.uint64)
        np.cumsum(B.mixed(hashes, seed), out=sums[1:])
        names.append(sums[first[1:]] - sums[first[:-1]])
    return n, B.mixed(names[0] ^ B.mixed(names[1], 3) + n.astype(np.uint64)).view(np.int64)


def _signer(shingle: int, percent: int, order):
    def sign(batches):
        for batch in batches:
            for begin, end, doc, hashes in shingle_sets(batch["text"], shingle):
                doc, hashes = _distinct(doc, hashes, order.value)
                n, name = _class(doc, hashes, end - begin)
                first = np.concatenate([[0], np.cumsum(n)])
                needed = -(-percent * n // 100)
                length = n - needed + np.minimum(needed, SHARED)
                kept = np.arange(len(doc)) - first[doc] < length[doc]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(hashes[kept].view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(begin, end - begin), pa.array(name), pa.array(n.astype(np.int64)), lists], ["id", "class", "n", "prefix"]
                )

    return sign


def _set_maker(shingle: int):
    def make(batches):
        for batch in batches:
            for begin, end, doc, hashes in shingle_sets(batch["text"], shingle):
                doc, hashes = _distinct(doc, hashes, None)
                n, name = _class(doc, hashes, end - begin)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(name), batch["wanted"].slice(begin, end - begin), lists], ["class", "wanted", "tokens"])

    return make


def _namer(shingle: int):
    """Class and text of each text with words."""

    def name(batches):
        for batch in batches:
            for begin, end, doc, hashes in shingle_sets(batch["text"], shingle):
                doc, hashes = _distinct(doc, hashes, None)
                n, names = _class(doc, hashes, end - begin)
                named = pa.RecordBatch.from_arrays([pa.array(names), batch["text"].slice(begin, end - begin)], ["class", "text"])
                yield named.filter(pa.array(n > 0))

    return name


def _whole_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all distinct shingles of some texts."""

    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin, _, doc, found in shingle_sets(texts, shingle):
        doc, found = _distinct(doc, found, None)
        rows.append(doc + begin)
        hashes.append(found)
    return np.concatenate(rows), np.concatenate(hashes)


def _pair_checker(shingle: int, percent: int):
    """Pairs (a, b) whose texts reach the threshold."""

    def check(batches):
        for batch in batches:
            ends = B.text_bytes(batch["one"])[1] + B.text_bytes(batch["two"])[1]
            for begin, end in B.pieces(ends):
                part = batch.slice(begin, end - begin)
                sides = [_whole_sets(part[side], shingle) for side in ("one", "two")]
                row, hashes = (np.concatenate(x) for x in zip(*sides))
                by = np.lexsort((hashes, row))
                row, hashes = row[by], hashes[by]
                both = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
                overlap = np.bincount(row[1:][both], minlength=part.num_rows)
                union = np.bincount(row, minlength=part.num_rows) - overlap
                yield part.select(["a", "b"]).filter(pa.array(overlap * 100 >= union * percent))

    return check


def _frequencies(source: DataFrame, shingle: int) -> np.ndarray:
    """Rough document frequency of all shingles: eighths of powers of two per cell of their hashes, as one byte.

    The frequencies only order tokens, so their roughness cannot lose a link.
    """

    def cells(batch):
        for _, _, doc, hashes in shingle_sets(batch["text"], shingle):
            yield _distinct(doc, hashes, None)[1] >> np.uint64(64 - CELL_BITS)

    return _table(source.select("text"), cells)


def _bitmap(wanted: DataFrame):
    """A bit per cell of the ids: set where any of ``wanted_id`` falls. It thins out what is joined, and decides nothing."""

    def cells(batch):
        yield _id_cells(batch["wanted_id"])

    return wanted.sparkSession.sparkContext.broadcast(np.packbits(_table(wanted.select("wanted_id"), cells) > 0))


def _id_cells(ids: pa.Array) -> np.ndarray:
    values = np.asarray(ids.fill_null(-1)).astype(np.int64).view(np.uint64)
    return B.mixed(values) >> np.uint64(64 - CELL_BITS)


def _likely(bits):
    def pick(batches):
        flags = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(flags[_id_cells(batch["id"])]))

    return pick


def _table(rows: DataFrame, cells) -> np.ndarray:
    """How often ``cells`` of the batches name each cell, as eighths of powers of two in one byte.

    Tasks count over all their rows and send compressed slices, which are summed as a stream. The driver gets one
    byte per cell.
    """

    slices = 1 << (CELL_BITS - SLICE_BITS)

    def count(batches):
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for found in cells(batch):
                at, times = np.unique(found, return_counts=True)
                counts[at] += times.astype(np.uint32)
        for number, part in enumerate(counts.reshape(slices, -1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": [number], "cells": [zlib.compress(part.tobytes(), 1)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(batch["slice"].to_pylist(), batch["cells"].to_pylist()):
                one = np.frombuffer(zlib.decompress(packed), np.uint32)
                sums[number] = sums[number] + one if number in sums else one.astype(np.uint64)
        for number, total in sums.items():
            eighths = np.minimum(np.ceil(8 * np.log2(total.astype(np.float64) + 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"slice": [number], "cells": [zlib.compress(eighths.tobytes(), 1)]})

    shape = "slice long, cells binary"
    table = np.zeros((slices, 1 << SLICE_BITS), np.uint8)
    for row in rows.mapInArrow(count, shape).repartition("slice").mapInArrow(add, shape).collect():
        table[row["slice"]] = np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    return table.reshape(-1)
