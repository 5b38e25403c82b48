"""Hard negatives by slot-decomposed selection.

An anchor's positives each ask for the best negatives inside a score window of their own. The windows overlap, but
their upper limits cut the scores into disjoint slots: a combiner keeps the best few negatives of each slot, and as
slots descend, the answer for any window is found in the merged slots from its own upper limit downwards.

Scores are integers and exact. Anchors are compared with all rows in cells, blocks of anchors by blocks of rows, of a
fixed size: a cell is one task's matrix products, whatever the number of anchors, rows or labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relops.columns import col
from relops.staging import stage

POSITIVES = 5
NEGATIVES = 5
SCALE = 256
# A positive's window, in percent of its score.
LOW_PERCENT, HIGH_PERCENT = 80, 100
# Anchors and rows of one cell, and scores computed at once.
CELL = 1 << 18
TILE = 1 << 22
# Components beyond this many bits are refused, so that a product fits 64 bits.
COMPONENT_BITS = 31

FOUND = "anchor long, anchor_id long, slot int, id long, row long, score long"


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = SCALE,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    cell: int = CELL,
) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` of other labels.

    A component x counts as floor(scale * x), a score is the integer inner product with the anchor; higher scores come
    first, ties by smaller id, null ids last. A negative's score lies between ``low_percent`` and ``high_percent`` of
    the positive's. Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and
    ``negative_score``; a positive without any negative has no row.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A row is itself, not its
    id: rows with equal ids are different rows, and an anchor is no positive of itself only. Of vectors of unequal
    length the common components count. Other columns are not looked at. A scaled component of 31 bits or more, or
    products that could pass 64 bits, fail the job.
    """

    rows, count, anchors, narrow = _prepared(vectors, is_anchor, id_col, vector_col, label_col, scale)
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    grid = max(1, -(-anchors // cell)), max(parallel, -(-count // cell))
    rows = rows.select("row", "id", "label", F.col("vector").cast(narrow), "anchor")
    chosen = rows.filter("anchor").select("row", "id", "label", "vector")
    everyone = rows.select("row", "id", "label", "vector")

    best = _cells(chosen, everyone, grid, _positives(positives))
    near = _first(best, ["anchor"], positives).select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    high = _floor_percent(F.col("positive_score"), high_percent)
    low = -_floor_percent(-F.col("positive_score"), low_percent)
    near = near.withColumns({"high": high, "low": low})

    limits = near.filter("low <= high").groupBy("anchor").agg(F.sort_array(F.collect_set("high"), asc=False).alias("limits"), F.min("low").alias("floor"))
    slotted = chosen.join(limits.withColumnRenamed("anchor", "at"), F.col("row") == F.col("at")).drop("at")
    kept = _first(_cells(slotted, everyone, grid, _slots(negatives)), ["anchor", "slot"], negatives)

    one = F.struct("slot", (-F.col("score")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row", "score")
    merged = kept.groupBy(F.col("anchor").alias("of")).agg(F.sort_array(F.collect_list(one)).alias("merged"))
    answers = near.join(limits.select(F.col("anchor").alias("at"), "limits"), F.col("anchor") == F.col("at")).join(merged, F.col("anchor") == F.col("of"))
    slot = F.array_position("limits", F.col("high")) - 1
    downwards = F.slice(F.filter("merged", lambda e: e["slot"] >= F.col("slot")), 1, negatives)
    answers = answers.filter("low <= high").withColumn("slot", slot).withColumn("answer", F.filter(downwards, lambda e: e["score"] >= F.col("low")))
    shown = answers.select("anchor_id", "positive_id", "positive_score", F.posexplode_outer("answer").alias("place", "one")).filter("place is not null")
    return shown.select(
        "anchor_id",
        "positive_id",
        (F.col("place") + 1).alias("rank"),
        F.col("one.id").alias("negative_id"),
        "positive_score",
        F.col("one.score").alias("negative_score"),
    )


def _floor_percent(score: Column, percent: int) -> Column:
    """floor(score * percent / 100), hundreds and rest apart so that large scores do not overflow."""

    def hundreds(value: Column) -> Column:
        return F.call_function("div", value - F.pmod(value, F.lit(100)), F.lit(100).cast("long"))

    return hundreds(score) * percent + hundreds(F.pmod(score, F.lit(100)) * percent)


def _prepared(
    vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int
) -> tuple[DataFrame, int, int, str]:
    """Rows that take part, written once with a number each; how many, how many anchors, and the narrowest component type."""

    vector = col(vector_col)
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    most = 2**COMPONENT_BITS
    fits = F.forall(scaled, lambda x: (x > -most) & (x < most))
    fitted = F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a scaled component has {COMPONENT_BITS} bits or more")))
    part = vectors.filter(col(label_col).isNotNull() & vector.isNotNull() & ~F.coalesce(broken, F.lit(False)))
    part = part.select(
        col(id_col).cast("long").alias("id"), col(label_col).alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), fitted.cast("array<int>").alias("vector")
    )
    rows = stage(part, "vectors")
    name = F.col("_metadata.file_name")
    part, more = (F.regexp_extract(name, r"^part-(\d+)-.*-c(\d+)", i).cast("long") for i in (1, 2))
    rows = rows.withColumn("row", F.shiftleft(part, 40) + F.shiftleft(more, 32) + F.col("_metadata.row_index"))
    largest = F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))))
    count, anchors, largest = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), largest).first()
    return rows, count, anchors, "array<smallint>" if (largest or 0) < 2**15 else "array<int>"


def _cells(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``work`` on every block of anchors with every block of rows. Rows are sent once per block of anchors, and the other way round."""

    down, across = grid
    place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Anchors are rows too; columns of their own tell the two sides apart.
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    left = anchors.withColumn("a", place(down)).withColumn("r", every(across)).repartition(down * across, "a", "r")
    right = rows.withColumn("r", place(across)).withColumn("a", every(down)).repartition(down * across, "a", "r")
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(work, FOUND)


def _first(found: DataFrame, group: list[str], count: int) -> DataFrame:
    """The first ``count`` of each group; Spark cuts every task's groups before the shuffle."""

    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= count).drop("nth")


class _Side:
    """Rows of one cell in the order of their ids, nulls last: matrices by vector length."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table.select(["id", "row"]), sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end")
        table = table.take(order).combine_chunks()
        self.table = table
        self.row = table["row"].to_numpy()
        self.values = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.lengths = pc.list_value_length(table["vector"]).to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def parts(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """The chosen rows by vector length."""

        for length in np.unique(self.lengths[chosen]):
            yield chosen[self.lengths[chosen] == length], int(length)

    def matrix(self, chosen: np.ndarray, length: int) -> np.ndarray:
        return self.values[self.starts[chosen, None] + np.arange(length)]


def _products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in the fastest type that holds every partial sum."""

    width = min(one.shape[1], two.shape[1])
    one, two = one[:, :width], two[:, :width]
    if not one.size or not two.size:
        return np.zeros((len(one), len(two)), np.float64)
    bound = int(np.abs(one.astype(np.int64)).max()) * int(np.abs(two.astype(np.int64)).max()) * width
    if bound >= 2**63:
        raise OverflowError("inner products could pass 64 bits")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return one.astype(kind) @ two.astype(kind).T


def _tiles(one: _Side, ours: np.ndarray, two: _Side, theirs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and scores of the chosen rows of two sides, at most ``TILE`` scores at once."""

    for left, d in one.parts(ours):
        for right, e in two.parts(theirs):
            wide = min(len(right), TILE)
            for begin in range(0, len(right), wide):
                across = right[begin : begin + wide]
                matrix = two.matrix(across, e)
                high = max(1, TILE // max(len(across), d, 1))
                for top in range(0, len(left), high):
                    down = left[top : top + high]
                    yield down, across, _products(one.matrix(down, d), matrix)


def _best(group: np.ndarray, score: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
    """Indices of the first ``count`` of each group, by score descending, then place."""

    order = np.lexsort((place, -score, group))
    group = group[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = group[1:] != group[:-1]
    begins = np.flatnonzero(fresh)
    nth = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
    return order[nth < count]


class _Found:
    """What the tiles of a cell gave, cut to the best of each group whenever it grows."""

    def __init__(self, count: int):
        self.count, self.size = count, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, group: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        kept = _best(group, score, place, self.count)
        self.parts.append((group[kept], score[kept].astype(np.int64), place[kept]))
        self.size += len(kept)
        if self.size > TILE:
            self.close()

    def close(self) -> tuple[np.ndarray, ...]:
        none = (np.zeros(0, np.int64),) * 3
        group, score, place = (np.concatenate(x) for x in zip(none, *self.parts))
        kept = _best(group, score, place, self.count)
        self.parts = [(group[kept], score[kept], place[kept])]
        self.size = 2 * len(kept) if len(kept) > TILE // 2 else len(kept)
        return self.parts[0]

    def table(self, one: _Side, two: _Side, slots: int) -> pa.Table:
        group, score, place = self.close()
        anchor = group // slots
        return pa.table(
            {
                "anchor": pa.array(one.row[anchor]),
                "anchor_id": one.table["id"].take(pa.array(anchor)),
                "slot": pa.array((group % slots).astype(np.int32)),
                "id": two.table["id"].take(pa.array(place)),
                "row": pa.array(two.row[place]),
                "score": pa.array(score),
            }
        )


def _codes(one: _Side, two: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the labels, the same on both sides."""

    labels = pa.chunked_array([*one.table["label"].chunks, *two.table["label"].chunks], type=one.table["label"].type)
    codes = labels.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes[: len(one.row)], codes[len(one.row) :]


def _positives(count: int):
    """The best rows of each anchor's own label in a cell, itself left out."""

    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        one, two, found = _Side(anchors), _Side(rows), _Found(count)
        ours, theirs = _codes(one, two)
        for label in np.unique(ours):
            for down, across, scores in _tiles(one, np.flatnonzero(ours == label), two, np.flatnonzero(theirs == label)):
                others = one.row[down, None] != two.row[across]
                # One more than asked for: the anchor itself may be among them.
                nth = max(scores.shape[1] - count - 1, 0)
                least = np.partition(scores, nth, axis=1)[:, nth]
                i, j = np.nonzero((scores >= least[:, None]) & others)
                found.add(down[i], scores[i, j], across[j])
        return found.table(one, two, 1)

    return work


def _slots(count: int):
    """The best rows of other labels in each slot of each anchor."""

    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        one, two, found = _Side(anchors), _Side(rows), _Found(count)
        ours, theirs = _codes(one, two)
        lists = one.table["limits"].to_pylist()
        slots = max([len(x) for x in lists], default=1)
        limits = np.array([[*x, *[-(2**63)] * (slots - len(x))] for x in lists], np.int64).reshape(-1, slots)
        floor = one.table["floor"].to_numpy()
        for down, across, scores in _tiles(one, np.arange(len(ours)), two, np.arange(len(theirs))):
            inside = (scores >= floor[down, None]) & (scores <= limits[down, :1]) & (ours[down, None] != theirs[across])
            i, j = np.nonzero(inside)
            score = scores[i, j].astype(np.int64)
            slot = (limits[down[i]] >= score[:, None]).sum(axis=1) - 1
            found.add(down[i] * slots + slot, score, across[j])
        return found.table(one, two, slots)

    return work
