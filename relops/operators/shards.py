"""Dates of sharded tables, over a listing of table ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relops.functions.names import SHARD_FORMAT, SHARD_SUFFIX, shard_base, shard_date


class NoShard(IndexError):
    """A sharded table has no shard in range."""


def shards_of(names: DataFrame, base: str, column: str = "table_id") -> DataFrame:
    """Rows whose table id is ``base`` and exactly eight digits, with the digits as ``shard_date``."""

    suffix = F.substring(F.col(column), F.lit(len(base) + 1), F.length(column))
    ours = names.filter(F.col(column).startswith(base) & suffix.rlike("^[0-9]{8}$"))
    return ours.withColumn("shard_date", F.to_date(suffix, SHARD_FORMAT))


def shard_dates(
    names: DataFrame, base: str, end_date: dt.date | None = None, limit: int | None = 1, column: str = "table_id"
) -> DataFrame:
    """Distinct shard dates no later than ``end_date``, newest first."""

    found = shards_of(names, base, column).select("shard_date").distinct()
    if end_date is not None:
        found = found.filter(F.col("shard_date") <= F.lit(end_date).cast("date"))
    found = found.orderBy(F.col("shard_date").desc())
    return found if limit is None else found.limit(limit)


def latest_table(
    names: DataFrame, base: str, end_date: dt.date | None = None, sharded: bool = True, column: str = "table_id"
) -> str:
    """``base`` with its newest shard date, or ``base`` itself when it is not sharded."""

    if not sharded:
        return base
    row = shard_dates(names, base, end_date, 1, column).first()
    if row is None:
        raise NoShard(f"no shard of {base} up to {end_date}")
    return f"{base}{row['shard_date']:%Y%m%d}"


def latest_tables(names: DataFrame, end_date: dt.date | None = None, column: str = "table_id") -> DataFrame:
    """For every sharded base in a listing the id of its newest table, by a combining aggregation."""

    sharded = names.filter(F.col(column).rlike(SHARD_SUFFIX)).select(
        shard_base(F.col(column)).alias("base"), shard_date(F.col(column)).alias("shard_date")
    )
    if end_date is not None:
        sharded = sharded.filter(F.col("shard_date") <= F.lit(end_date).cast("date"))
    newest = sharded.groupBy("base").agg(F.max("shard_date").alias("shard_date"))
    return newest.select("base", F.concat("base", F.date_format("shard_date", SHARD_FORMAT)).alias("table_id"))
