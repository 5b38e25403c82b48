"""The three ways a release is published: change files, snapshot shard, partition."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relops.operators.incremental import apply_changes, merge_changefiles
from relops.operators.registry import Release, add_release
from relops.plans.merge import change_table
from relops.sinks.tables import (
    WRITE_EMPTY,
    drop_partition,
    replace_partitions,
    save_partitioned,
    save_table,
    snapshot_table,
    whole_table,
)
from relops.sources.schemas import conform
from relops.sources.tables import read_table, table_exists
from relops.staging import stage


@dataclasses.dataclass(kw_only=True)
class Target:
    """Table a release goes to, and the registry that records it."""

    table: str
    registry: str
    dag_id: str
    entity_id: str
    dag_run_id: str | None = None


def _register(spark: SparkSession, target: Target, now: dt.datetime, **dates) -> None:
    release = Release(
        dag_id=target.dag_id,
        entity_id=target.entity_id,
        dag_run_id=target.dag_run_id,
        created=now,
        modified=now,
        **dates,
    )
    add_release(spark, target.registry, release)


def changefile_result(
    main: DataFrame,
    changes: DataFrame,
    deletes: DataFrame | None,
    keys: str | Sequence[str],
    seq: str,
    delete_keys: str | Sequence[str] | None = None,
) -> DataFrame:
    """Main table after a set of change files: last file per key, upsert, then deletes."""

    last = merge_changefiles(changes, keys, seq).drop(seq)
    return apply_changes(main, last.select(*main.columns), deletes, keys, delete_keys)


def apply_changefile_release(
    spark: SparkSession,
    target: Target,
    changes: DataFrame,
    deletes: DataFrame | None,
    keys: str | Sequence[str],
    seq: str,
    *,
    start_date: dt.datetime,
    end_date: dt.datetime,
    now: dt.datetime,
    snapshot: str | None = None,
    snapshot_expires_at: dt.datetime | None = None,
) -> DataFrame:
    """Snapshot the main table, merge the change files into it, apply deletes, register. Returns the new table.

    The changes are read once: merged and written with their sequence numbers, for matches, inserts and the registry.
    Of a partitioned or grouped main table only what they fall in is read whole and rewritten.
    """

    if snapshot:
        snapshot_table(spark, target.table, snapshot, snapshot_expires_at)
    span = Observation()
    numbered = changes.observe(span, F.min(seq).alias("first"), F.max(seq).alias("last"))
    last = stage(merge_changefiles(stage(numbered, "changefiles"), keys, seq).drop(seq), "changes")
    bounds = span.get
    main = whole_table(spark, target.table)
    change_table(spark, target.table, last.select(*main.columns), deletes, keys)
    _register(
        spark,
        target,
        now,
        changefile_start_date=start_date,
        changefile_end_date=end_date,
        sequence_start=bounds["first"],
        sequence_end=bounds["last"],
    )
    return whole_table(spark, target.table)


def apply_snapshot_release(
    spark: SparkSession, target: Target, df: DataFrame, snapshot_date: dt.datetime, now: dt.datetime, schema=None
) -> DataFrame:
    """A new shard of ``target.table`` for the snapshot date, then register. Returns the shard."""

    if schema is not None:
        df = conform(df, schema)
    shard = f"{target.table}{snapshot_date:%Y%m%d}"
    save_table(df, shard, WRITE_EMPTY)
    _register(spark, target, now, snapshot_date=snapshot_date)
    return read_table(spark, shard)


def apply_partition_release(
    spark: SparkSession,
    target: Target,
    df: DataFrame,
    partition_date: dt.datetime,
    now: dt.datetime,
    *,
    field: str = "snapshot_date",
    kind: str = "DAY",
) -> DataFrame:
    """Stamp the rows with the partition date and replace that partition alone, then register.

    A release without rows leaves the partition empty.
    """

    stamped = df.withColumn(field, F.lit(partition_date).cast("timestamp_ntz" if kind == "HOUR" else "date"))
    if table_exists(spark, target.table):
        if stamped.isEmpty():
            drop_partition(df.sparkSession, target.table, partition_date)
        else:
            replace_partitions(stamped, target.table)
    else:
        save_partitioned(stamped, target.table, field, kind)
    _register(spark, target, now, partition_date=partition_date)
    return whole_table(spark, target.table)
