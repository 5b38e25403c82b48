"""Written intermediates: cut lineage, and give rows a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.session import scratch_path
from relops.sizing import range_partitions

CHUNK = "__relops_chunk"
ROW = "__relops_row"


def stage(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write once below the shared folder and read back; a lost executor re-reads instead of recomputing."""

    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_in_order(df: DataFrame, order: Sequence[str], *, in_task: dict[str, Column] | None = None) -> DataFrame:
    """Globally sorted copy of ``df`` whose rows know their place: file number ``_chunk``, row in file ``_row``.

    Range partitioning balances the files by row count whatever the key distribution, as long as ``order`` is
    unique. Their number follows from what ``df`` scans. ``in_task`` adds columns computed after the sort,
    for iterator UDFs that read a task's rows in order.
    """

    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    placed = df.repartitionByRange(range_partitions(df), *order).sortWithinPartitions(*order)
    if in_task:
        placed = placed.withColumns(in_task)
    placed.write.option("maxRecordsPerFile", 0).parquet(path)
    return (
        spark.read.schema(placed.schema)
        .parquet(path)
        .withColumn(CHUNK, F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int"))
        .withColumn(ROW, F.col("_metadata.row_index"))
    )


def chunk_offsets(staged: DataFrame, total: Column) -> DataFrame:
    """Per staged file the sum of ``total`` over all earlier files; one row per file, so safe to broadcast."""

    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return (
        staged.groupBy(CHUNK)
        .agg(total.cast("long").alias("__relops_total"))
        .select(CHUNK, F.coalesce(F.sum("__relops_total").over(before), F.lit(0)).cast("long").alias("__relops_offset"))
    )


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """0-based position of every row in ``order`` (which must be unique), as an exact two-pass count."""

    staged = stage_in_order(df, order)
    offsets = chunk_offsets(staged, F.count(F.lit(1)))
    return (
        staged.join(F.broadcast(offsets), CHUNK)
        .withColumn(name, F.col("__relops_offset") + F.col(ROW))
        .drop(CHUNK, ROW, "__relops_offset")
    )


def chunk_rows(df: DataFrame, size: int, order: Sequence[str], name: str = "chunk") -> DataFrame:
    """Rows with the 0-based number of their chunk of ``size`` rows in ``order`` (which must be unique); the last may be shorter."""

    if size < 1:
        raise ValueError("chunk size must be at least 1")
    return with_row_index(df, order, name).withColumn(name, F.floor(F.col(name) / size))


RUN = T.StructType([T.StructField("size", T.LongType()), T.StructField("before", T.LongType())])


@F.pandas_udf(RUN)
def running_size(sizes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Size of each row and the sum of those before it in the same task."""

    carried = 0
    for batch in sizes:
        upto = batch.cumsum() + carried
        yield pd.DataFrame({"size": batch, "before": upto - batch})
        if len(batch):
            carried = int(upto.iloc[-1])


def with_sum_before(df: DataFrame, run: Column, order: Sequence[str], name: str = "size_before") -> DataFrame:
    """Exact running sum over all earlier rows in ``order`` (which must be unique).

    First pass: each sorted task sums its own rows; ``run`` is an iterator UDF giving (size, before), such as
    ``running_size(column)``, so only that column leaves the JVM. Second pass: add the total of the earlier files.
    """

    staged = stage_in_order(df, order, in_task={"__relops_run": run})
    offsets = chunk_offsets(staged, F.max(F.col("__relops_run.before") + F.col("__relops_run.size")))
    return (
        staged.join(F.broadcast(offsets), CHUNK)
        .withColumn(name, F.col("__relops_offset") + F.col("__relops_run.before"))
        .drop(CHUNK, ROW, "__relops_offset", "__relops_run")
    )
