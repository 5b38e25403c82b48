"""Transfer job states, fetch-section counts, and ages of tables and files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relops.columns import col
from relops.functions.dates import monthly_sections, section_index

# States of a transfer operation.
SUCCESS, FAILED, ABORTED, IN_PROGRESS = "SUCCESS", "FAILED", "ABORTED", "IN_PROGRESS"


def transfer_rollup(
    operations: DataFrame, job: str = "job", status: str = "status", objects: str = "objects_found"
) -> DataFrame:
    """Per job: operations by status, objects found (missing counts as 0), and the job's state.

    All succeeded is SUCCESS; else any failure FAILED, any abort ABORTED; else IN_PROGRESS.
    """

    def n(value: str) -> Column:
        return F.count_if(col(status) == value)

    rolled = operations.groupBy(col(job)).agg(
        F.count(F.lit(1)).alias("n_operations"),
        n(SUCCESS).alias("n_success"),
        n(FAILED).alias("n_failed"),
        n(ABORTED).alias("n_aborted"),
        n(IN_PROGRESS).alias("n_in_progress"),
        F.sum(F.coalesce(col(objects).cast("bigint"), F.lit(0))).alias("n_objects"),
    )
    state = (
        F.when(F.col("n_success") >= F.col("n_operations"), SUCCESS)
        .when(F.col("n_failed") >= 1, FAILED)
        .when(F.col("n_aborted") >= 1, ABORTED)
        .otherwise(IN_PROGRESS)
    )
    return rolled.withColumn("state", state)


def section_counts(events: DataFrame, ts: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rows per monthly fetch section, empty sections included.

    A row's section follows from its date by arithmetic, so nothing is joined to the rows: they are combined to
    one count per section and only those meet the sections.
    """

    time = col(ts).cast("timestamp_ntz")
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    sections = events.sparkSession.range(1).select(F.posexplode(monthly_sections(first, last)).alias("section", "s"))
    inside = events.filter((time >= first) & (time < last)).withColumn("__relops_section", section_index(time, first))
    # A section can end before the next begins; what falls in between belongs to none.
    begins = first + F.make_ym_interval(F.lit(0), F.col("__relops_section"))
    ends = (begins + F.expr("INTERVAL 1 MONTH")).cast("date").cast("timestamp_ntz")
    counts = inside.filter(time < ends).groupBy("__relops_section").agg(F.count(F.lit(1)).alias("__relops_n"))
    return sections.join(counts, F.col("section") == F.col("__relops_section"), "left").select(
        F.col("s.section_start").alias("section_start"),
        F.col("s.section_end").alias("section_end"),
        F.coalesce(F.col("__relops_n"), F.lit(0)).cast("bigint").alias("n_rows"),
    )


def expired(
    inventory: DataFrame,
    age_hours: float,
    now: dt.datetime | Column,
    *,
    prefix: str = "",
    name: str = "name",
    created: str = "created",
) -> DataFrame:
    """Entries named ``prefix…`` whose age in (fractional) hours has reached ``age_hours``."""

    at = now if isinstance(now, Column) else F.lit(now)
    kind = inventory.schema[created].dataType
    micros = F.timestamp_diff("MICROSECOND", col(created), at.cast(kind))
    return inventory.filter(col(name).startswith(prefix)).filter(micros >= F.lit(int(age_hours * 3_600_000_000)))
