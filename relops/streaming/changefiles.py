"""Change files picked up as they arrive in a folder; the stream's checkpoint knows which were taken."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from relops.plans.releases import Target, apply_changefile_release
from relops.sinks.tables import WRITE_TRUNCATE, drop_snapshot, save_table, snapshot_table, whole_table
from relops.sources.tables import table_exists
from relops.versions import set_properties, table_properties

SEQ = "__relops_sequence"
# The batch that a snapshot was taken for.
RUN_ID = "relops.run_id"


class OutOfOrder(ValueError):
    """A change file arrived whose sequence number lies before what was already applied."""


def sequence_of_file(pattern: str = r"([0-9]+)[^0-9]*$") -> Column:
    """Sequence number in the name of the file a row was read from: by default its last digits before the extension."""

    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.(?:jsonl?|csv)(?:\.gz)?$", "")
    return F.regexp_extract(stem, pattern, 1).cast("bigint")


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def apply_arriving_changefiles(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    target: Target,
    keys: str | Sequence[str],
    checkpoint: str,
    *,
    sequence: Column | None = None,
    clock: Callable[[], dt.datetime] = _utc_now,
) -> StreamingQuery:
    """Apply all JSON-lines change files not yet taken from ``folder`` as one release, then stop.

    Within the release the last file per key wins. A batch that is run again after a failure is recognised in the
    registry by its run id, which names the checkpoint too: a new checkpoint counts its batches from 0 again. Before it
    is merged the table is kept as it is, in a snapshot that bears the run id and goes once the release is registered: a
    batch that failed in between finds it and starts from there, so updates with a null key are inserted once.
    """

    seq = sequence_of_file() if sequence is None else sequence
    arriving = spark.readStream.schema(schema).option("mode", "FAILFAST").json(folder).withColumn(SEQ, seq)

    def apply(batch: DataFrame, batch_id: int) -> None:
        run_id = f"changefiles-{_stream_id(spark, checkpoint)}-{batch_id}"
        applied = _applied(spark, target)
        before = f"{target.table}__before_release"
        if spark.catalog.tableExists(before):
            begun = table_properties(spark, before).get(RUN_ID)
            if begun is not None and not _registered(spark, target, begun):
                save_table(whole_table(spark, before), target.table, WRITE_TRUNCATE)
            drop_snapshot(spark, before)
        if batch.isEmpty() or (applied is not None and run_id in applied[1]):
            return
        first = batch.agg(F.min(SEQ).alias("first")).first()["first"]
        if applied is not None and applied[0] is not None and first <= applied[0]:
            raise OutOfOrder(f"change file {first} arrived after {applied[0]} was applied")
        now = clock()
        release = Target(**{**vars(target), "dag_run_id": run_id})
        snapshot_table(spark, target.table, before)
        set_properties(spark, before, {RUN_ID: run_id})
        apply_changefile_release(spark, release, batch, None, keys, SEQ, start_date=now, end_date=now, now=now)
        drop_snapshot(spark, before)

    stream = arriving.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def _registered(spark: SparkSession, target: Target, run_id: str) -> bool:
    if not table_exists(spark, target.registry):
        return False
    ours = (F.col("dag_id") == target.dag_id) & (F.col("entity_id") == target.entity_id)
    return not spark.table(target.registry).filter(ours & (F.col("dag_run_id") == run_id)).isEmpty()


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity Spark gave the stream when its checkpoint was begun."""

    return spark.read.json(f"{checkpoint.rstrip('/')}/metadata", schema="id string").first()["id"]


def _applied(spark: SparkSession, target: Target) -> tuple[int | None, set[str]] | None:
    """Highest sequence number applied so far, and the run id that applied it; None without a registry."""

    if not table_exists(spark, target.registry):
        return None
    ours = (F.col("dag_id") == target.dag_id) & (F.col("entity_id") == target.entity_id)
    row = (
        spark.table(target.registry)
        .filter(ours)
        .agg(F.max("sequence_end").alias("last"), F.max_by("dag_run_id", "sequence_end").alias("run"))
        .first()
    )
    return (None if row["last"] is None else int(row["last"])), {row["run"]}
