"""Documents in shards by id, and rounds of questions between shards and key buckets.

A shard asks which of its keys other shards hold too; a bucket, which gets a range of all keys, answers with two
bits for each. A key is sent once per shard, however often it occurs, so a passage that a third of all documents
share costs a bucket no more than one key per shard. Shards cover ascending id ranges, so "an earlier shard has it"
means "a document with a smaller id has it".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relops.columns import col
from relops.staging import stage

SHARD_BYTES = 4 << 20
# Quantiles of all ids, which the driver holds; each range between two is divided by quantiles of its own.
QUANTILES = 1000
# Stands for a null id: later than all others.
NO_ID = 2**63 - 1
# Shards of documents without an id count from here. No document is later than another of them.
NO_ID_SHARD = 1 << 40
# Keys of a bucket: more of them before there are more than so many buckets, up to what a task holds.
BUCKET_KEYS, BUCKETS, MOST_BUCKET_KEYS = 400_000, 512, 4_000_000

# The largest number of shards an answer counts up to.
MANY = 127

ASKED = "bucket long, shard long, keys binary, shared binary, state binary"
REPLIED = "shard long, bucket long, n long, holders binary, earlier binary, state binary"


@dataclass
class Shard:
    """Documents of one shard in id order: ids, the bytes of their texts, and where each text begins."""

    ids: np.ndarray
    known: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Question:
    """Ascending distinct keys; whether two documents of the shard share each; what to remember until the answer."""

    keys: np.ndarray
    shared: np.ndarray
    state: bytes = b""


@dataclass
class Answer:
    """For each key asked: how many shards have it, ``MANY`` at most; is there another document anywhere that has it,
    and an earlier shard; and what was remembered."""

    holders: np.ndarray
    elsewhere: np.ndarray
    earlier: np.ndarray
    state: bytes


@dataclass
class Round:
    """One question; ``key_bytes`` below 8 sends only that many bytes of a key besides its bucket, as a filter may."""

    ask: Callable[[Shard, Answer | None], Question]
    key_bytes: int = 8


def sharded(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> tuple[DataFrame, int]:
    """Rows (shard, id, text), shards ascending in id, and the bytes of all texts.

    Shards of about ``shard_bytes`` hold equal numbers of documents: quantiles of all ids make ranges, quantiles inside
    each range its shards, however the ids cluster and however many shards there are. Only the first are held by the
    driver; the others are written, as a lost executor must not change them, and broadcast: eight bytes a shard.
    Documents of one id share a shard. Those without any are dealt to shards of their own by their texts.
    """

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    size = F.octet_length("text")
    sums = [F.coalesce(F.sum(F.when(c, size)), F.lit(0)) for c in (F.col("id").isNotNull(), F.col("id").isNull())]
    total, without = map(int, rows.agg(*sums).first())
    shards = max(1, -(-total // shard_bytes))
    number = F.lit(0).cast("long")
    if shards > 1:
        number, rows = _shard_number(rows, shards)
    spare = NO_ID_SHARD + F.pmod(F.xxhash64("text"), F.lit(max(1, -(-without // shard_bytes))))
    return rows.select(F.when(F.col("id").isNull(), spare).otherwise(number).alias("shard"), "id", "text"), total + without


def _shard_number(rows: DataFrame, shards: int) -> tuple[Column, DataFrame]:
    """The shard of a row's id, and the rows with what it takes to tell."""

    ranges = min(shards, QUANTILES)
    cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []
    edges = F.lit(sorted(set(map(int, cuts)))).cast("array<bigint>")
    upto = lambda some: F.size(F.filter(some, lambda e: e <= F.col("id"))).cast("long")
    within = -(-shards // (len(set(cuts)) + 1))
    if within == 1:
        return upto(edges), rows
    rows = rows.withColumn("range", upto(edges))
    inner = rows.filter("id is not null").groupBy(F.col("range").alias("of"))
    inner = stage(inner.agg(F.percentile_approx("id", [i / within for i in range(1, within)], 10 * within).alias("cuts")), "cuts")
    rows = rows.join(F.broadcast(inner), F.col("range") == F.col("of"), "left")
    return F.col("range") * within + upto(F.array_distinct("cuts")), rows


def converse(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    rounds: list[Round],
    conclude: Callable[[Shard, Answer], pa.Table],
    schema: str,
    keys_per_mb: int,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Run the rounds over all documents and let each shard conclude from the last answer.

    The texts are shuffled once: every round reads the same exchange. ``keys_per_mb`` sizes the buckets.
    """

    texts, total = sharded(docs, id_col, text_col, shard_bytes)
    keys = total * keys_per_mb // (1 << 20)
    buckets = max(8, keys // min(max(BUCKET_KEYS, keys // BUCKETS), MOST_BUCKET_KEYS))
    replies = None
    for each in rounds:
        ask = _asker(each, buckets)
        if replies is None:
            asked = texts.groupBy("shard").applyInArrow(_first(ask), ASKED)
        else:
            asked = texts.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(ask, ASKED)
        replies = asked.groupBy("bucket").applyInArrow(_replier(each.key_bytes), REPLIED)

    def last(key, rows, answers):
        return conclude(_shard(rows), _answer(answers))

    return texts.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(last, schema)


def _shard(texts: pa.Table) -> Shard:
    from relops.llm.bytewise import text_bytes

    ids = texts["id"].combine_chunks()
    known = np.asarray(ids.is_valid())
    values = np.asarray(ids.fill_null(NO_ID))
    order = np.argsort(values, kind="stable")
    data, offsets = text_bytes(texts["text"].take(pa.array(order)))
    return Shard(values[order], known[order], data, offsets)


def _answer(rows: pa.Table) -> Answer:
    rows = rows.sort_by("bucket")
    holders, earlier, state = [np.zeros(0, np.uint8)], [np.zeros(0, bool)], b""
    for row in rows.to_pylist():
        if row["state"] is not None:
            state = row["state"]
        else:
            holders.append(np.frombuffer(row["holders"], np.uint8))
            earlier.append(np.unpackbits(np.frombuffer(row["earlier"], np.uint8), count=row["n"]).astype(bool))
    # The high bit says that two documents of the shard itself share the key.
    counted = np.concatenate(holders)
    number = counted & MANY
    return Answer(number, (number > 1) | (counted > MANY), np.concatenate(earlier), state)


def _bucket_edges(buckets: int) -> np.ndarray:
    return np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)


def _asker(each: Round, buckets: int) -> Callable:
    def ask(key, texts, answers):
        if texts.num_rows == 0:
            return pa.Table.from_pylist([], _ASKED)
        question = each.ask(_shard(texts), None if answers is None else _answer(answers))
        number = key[0].as_py()
        cuts = [0, *np.searchsorted(question.keys, _bucket_edges(buckets)).tolist(), len(question.keys)]
        rows = [{"bucket": -1 - number, "shard": number, "keys": None, "shared": None, "state": question.state}]
        for bucket, (begin, end) in enumerate(zip(cuts, cuts[1:])):
            if begin < end:
                sent = question.keys[begin:end].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : each.key_bytes]
                bits = np.packbits(question.shared[begin:end])
                rows.append({"bucket": bucket, "shard": number, "keys": sent.tobytes(), "shared": bits.tobytes(), "state": None})
        return pa.Table.from_pylist(rows, _ASKED)

    return ask


def _first(ask: Callable) -> Callable:
    return lambda key, texts: ask(key, texts, None)


_ASKED = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("shared", pa.binary()), ("state", pa.binary())])
_REPLIED = pa.schema(
    [("shard", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("holders", pa.binary()), ("earlier", pa.binary()), ("state", pa.binary())]
)


def _replier(key_bytes: int) -> Callable:
    def reply(key, rows):
        """Merge the shards' sorted runs, keep for each key its first shard, and find each run again by binary search."""

        rows = rows.sort_by("shard").to_pylist()
        if key[0].as_py() < 0:
            return pa.Table.from_pylist([{"shard": r["shard"], "bucket": r["bucket"], "n": 0, "state": r["state"]} for r in rows], _REPLIED)
        runs = []
        for row in rows:
            raw = np.frombuffer(row["keys"], np.uint8).reshape(-1, key_bytes)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :key_bytes] = raw
            runs.append(wide.reshape(-1).view("<u8"))
        merged, at, holders = np.unique(np.concatenate(runs), return_index=True, return_counts=True)
        owner = np.repeat([r["shard"] for r in rows], [len(r) for r in runs])[at]
        # A shard without ids is earlier than none.
        owner = np.where(owner >= NO_ID_SHARD, NO_ID, owner)
        out = []
        for row, run in zip(rows, runs):
            found = np.searchsorted(merged, run)
            shared = np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=len(run)).astype(bool)
            out.append(
                {
                    "shard": row["shard"],
                    "bucket": row["bucket"],
                    "n": len(run),
                    "holders": (np.minimum(holders[found], MANY) + 128 * shared).astype(np.uint8).tobytes(),
                    "earlier": np.packbits(owner[found] < row["shard"]).tobytes(),
                }
            )
        return pa.Table.from_pylist(out, _REPLIED)

    return reply


def distinct_keys(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, the place of each key among them, and the smallest and largest id that has each."""

    if not len(keys):
        none = np.zeros(0, np.int64)
        return keys, none, none, none
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    begins = np.flatnonzero(fresh)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    sorted_ids = ids[order]
    return ordered[begins], place, np.minimum.reduceat(sorted_ids, begins), np.maximum.reduceat(sorted_ids, begins)
