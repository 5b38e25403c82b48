"""Mixing of sources to target weights by pivotal rounding in a reduction tree."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relops.columns import col
from relops.llm import bytewise as B
from relops.llm.rowwise import annotate
from relops.staging import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
# Documents rounded together by one task of the tree.
BLOCK = 4096
# Sources are settings of a mix, one row each on the driver; more than this is refused.
MOST_SOURCES = 1_000_000


def word_counts(docs: DataFrame, text_col: str, keep: list[str], name: str = "size") -> DataFrame:
    """Number of words (ASCII white space between them) of each whole text; a null has none."""

    def count(texts: pa.Array) -> list[pa.Array]:
        data, offsets = B.text_bytes(texts)
        sizes = [np.zeros(0, np.int64)]
        for begin, end in B.pieces(offsets):
            at = offsets[begin]
            _, _, first = B.cut(data[at : offsets[end]], offsets[begin : end + 1] - at, B.SPACED)
            sizes.append(np.diff(first))
        return [pa.array(np.concatenate(sizes), pa.int64())]

    return annotate(docs, text_col, count, [(name, "bigint")], keep)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words each source should give: by weight, at most ``most`` times its size, the excess reshared by weight.

    Sources are ordered by code point, a null last, and weigh ``weights`` in turn. The total is ``share`` times all
    sizes.
    """

    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            out.update({s: unit * weight[s] for s in open_})
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    block: int = BLOCK,
) -> DataFrame:
    """How many copies of each document a mix takes, so that each source comes near its target.

    Every document of a source starts with the same number of copies, target / source size. Its whole part is taken;
    the fractions are rounded by pivots: two documents meet, words move from one fraction to the other at random, so
    that the expectation of both and the sum of words stay, until one is 0 or 1; the other goes on. Blocks of
    documents do this in parallel and hand one unsettled document each to the next level, where blocks of those do
    the same, up to one document per source. A source misses its target by less than that document's size. Random
    choices follow from ids and texts alone, so reruns agree, and rows without an id are spread by their texts.

    Returns one row per row of ``docs``: the id, ``source``, ``size`` (words), ``source_size``, ``target``,
    ``copies`` and ``taken`` (copies * size, at most ``most`` times the size). A null text has size 0, a null source
    is a source of its own, documents without words are taken once or as often as rounding says without weighing
    anything. Rows with equal ids are rounded each on its own. Other columns are not looked at.
    """

    text = col(text_col)
    named = docs.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"), F.xxhash64(col(id_col), text).alias("content"), text.alias("text"))
    sized = stage(word_counts(named, "text", ["id", "source", "content"]), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    aims = targets({r["source"]: r["source_size"] for r in per_source}, weights, share, most)
    rows = [(r["source"], r["source_size"], float(aims.get(r["source"], 0.0)), r["rows"]) for r in per_source]
    facts = sized.sparkSession.createDataFrame(rows or [(None, 0, 0.0, 0)], "of string, source_size long, target double, rows long")
    joined = sized.join(F.broadcast(facts), sized["source"].eqNullSafe(facts["of"])).drop("of")
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    level = joined.withColumn("whole", F.floor(share_of)).withColumn("fraction", share_of - F.floor(share_of))
    level = level.withColumn("order", F.xxhash64("content", F.lit("mix"))).drop("content").withColumn("settled", F.lit(False))

    most_rows = max([r["rows"] for r in per_source], default=0)
    done = []
    while True:
        blocks = F.ceil(F.col("rows") / block)
        level = level.withColumn("block", F.pmod(F.xxhash64("order", F.lit(len(done))), F.greatest(blocks, F.lit(1))))
        rounded = stage(level.groupBy("source", "block").applyInPandas(_round_block, level.schema), "rounded")
        done.append(rounded.filter("settled"))
        if most_rows <= block:
            # One block a source: its last document, if any, is settled by chance alone.
            done.append(rounded.filter("not settled").withColumn("fraction", _last("order", "fraction")))
            break
        most_rows = -(-most_rows // block)
        level = rounded.filter("not settled").withColumn("rows", F.ceil(F.col("rows") / block))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.round("fraction")).cast("long")
    return out.select(
        F.col("id").alias(id_col), F.col("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _last(order: str, fraction: str):
    chance = F.pmod(F.xxhash64(order, F.lit("last")), F.lit(1 << 30)) / float(1 << 30)
    return F.when(chance < F.col(fraction), 1.0).otherwise(0.0)


def _chance(one: int, other: int) -> float:
    """A number below 1 that depends on the two documents alone."""

    digest = hashlib.blake2b(f"{one},{other}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def _round_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["order", "size"], kind="stable", ignore_index=True)
    fraction, size, order = rows["fraction"].to_numpy(copy=True), rows["size"].tolist(), rows["order"].tolist()
    settled = np.ones(len(rows), bool)
    carried = -1
    for at in range(len(rows)):
        if not 0 < fraction[at] < 1:
            continue
        if size[at] == 0:
            # Weighs nothing, so it is rounded alone.
            fraction[at] = float(_chance(order[at], 0) < fraction[at])
        elif carried < 0:
            carried = at
        else:
            carried = _pivot(fraction, size, order, carried, at)
    if carried >= 0:
        settled[carried] = False
    rows["fraction"], rows["settled"] = fraction, settled
    return rows


def _pivot(fraction: np.ndarray, size: list[int], order: list[int], one: int, other: int) -> int:
    """Move words between two fractions until one is whole; returns the one that is not, or -1."""

    up = min((1 - fraction[one]) * size[one], fraction[other] * size[other])
    down = min(fraction[one] * size[one], (1 - fraction[other]) * size[other])
    if _chance(order[one], order[other]) * (up + down) < down:
        moved = up
    else:
        moved = -down
    fraction[one] += moved / size[one]
    fraction[other] -= moved / size[other]
    for at in (one, other):
        if fraction[at] < 1e-9 or fraction[at] > 1 - 1e-9:
            fraction[at] = np.round(fraction[at])
    open_ = [at for at in (one, other) if 0 < fraction[at] < 1]
    return open_[0] if open_ else -1
