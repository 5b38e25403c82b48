"""Exports: whole tables, size-bounded parts, transfer manifests."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.columns import col
from relops.staging import RUN, running_size, stage, with_row_index, with_sum_before

# Default part sizes and the manifest limit, in bytes.
PART_BYTES = 30 * 1024**3
PART_BYTES_GZ = int(3.9 * 1024**3)
MANIFEST_BYTES = 1024**3
_SYNC_BYTES = 64 * 1024
SLOT = "__relops_slot"
# Parts of an export that are a task each; of more, a task writes several one after the other, of so many bytes in all.
PART_TASKS = 1000
TASK_BYTES = 64 * 1024**2
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
# The writers' own defaults stop at milliseconds.
_TEXT_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def export_table(df: DataFrame, path: str, file_type: str) -> None:
    """CSV or JSON lines, each plain or gz, as one folder of files."""

    formats = {"csv": "csv", "csv.gz": "csv", "jsonl": "json", "jsonl.gz": "json"}
    if file_type not in formats:
        raise ValueError(f"file type {file_type} is not supported")
    writer = df.write.option("compression", "gzip" if file_type.endswith(".gz") else "none").options(**_TEXT_FORMATS)
    if formats[file_type] == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def _utf8_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


@F.pandas_udf(RUN)
def compressed_run(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Bytes each line adds to one gzip stream per task, flushed every 64 KiB and charged to the buffer's last line."""

    stream = zlib.compressobj(wbits=zlib.MAX_WBITS | 16)
    carried = 0
    # Beside the batch itself one buffer at a time is held.
    for batch in lines:
        sizes = np.zeros(len(batch), dtype=np.int64)
        ends = np.cumsum(np.fromiter((_utf8_bytes(text) + 1 for text in batch), np.int64, len(batch)))
        begin = first = 0
        while first < len(batch):
            # A buffer is closed by the line that fills it.
            last = min(int(np.searchsorted(ends, begin + _SYNC_BYTES)), len(batch) - 1)
            data = ("\n".join(batch.iloc[first : last + 1]) + "\n").encode()
            sizes[last] = len(stream.compress(data)) + len(stream.flush(zlib.Z_SYNC_FLUSH))
            begin, first = int(ends[last]), last + 1
        upto = sizes.cumsum() + carried
        yield pd.DataFrame({"size": sizes, "before": upto - sizes})
        carried += int(sizes.sum())


@contextmanager
def _text_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, whole lines go to Python in batches of at most ``BATCH_ROWS`` rows."""

    before = spark.conf.get(BATCH_CONF)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(BATCH_CONF, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def assign_parts(df: DataFrame, run: Column, order: Sequence[str], max_bytes: int) -> DataFrame:
    """Rows with their part number: parts follow ``order``, hold less than ``max_bytes`` plus one row, none is empty.

    A row belongs to the part its first byte falls in; part numbers are then closed up, since a row longer than
    the limit can leap over one. Both steps are exact two-pass counts, no single-task window.
    """

    return _numbered(df, run, order, max_bytes)[0]


def _numbered(df: DataFrame, run: Column, order: Sequence[str], max_bytes: int) -> tuple[DataFrame, int]:
    """Rows with their part number, and how many parts there are."""

    placed = with_sum_before(df, run, order)
    slot = F.expr(f"size_before div {int(max_bytes)}L")
    placed = placed.withColumn(SLOT, slot)
    numbers = stage(with_row_index(placed.select(SLOT).distinct(), [SLOT], "part"), "parts")
    return placed.join(numbers, SLOT).drop(SLOT), numbers.count()


def export_parts(
    df: DataFrame,
    path: str,
    order: Sequence[str],
    *,
    line: str | None = None,
    stem: str = "part",
    extension: str = "jsonl",
    max_bytes: int | None = None,
    compress: bool = False,
) -> None:
    """Ordered lines in files of bounded size: ``path/part_file=<stem><12 digits>.<extension>[.gz]/``.

    Lines are the column ``line``, or each row as JSON. Plain parts are bounded in bytes of text, gz parts in
    compressed bytes. Up to ``PART_TASKS`` parts are a task each, so ``max_bytes`` bounds a task and no two parts wait
    for one; of more and smaller parts a task writes consecutive ones, each whole, of at most ``TASK_BYTES`` together.
    """

    limit = max_bytes or (PART_BYTES_GZ if compress else PART_BYTES)
    text = col(line) if line else F.to_json(F.struct(*map(col, df.columns)), {"ignoreNullFields": "false"})
    keys = [f"__relops_o{i}" for i in range(len(order))]
    lines = df.select(*[col(o).alias(k) for o, k in zip(order, keys)], text.alias("value"))
    run = compressed_run("value") if compress else running_size(F.octet_length("value").cast("long") + 1)
    with _text_batches(df.sparkSession) if compress else nullcontext():
        parts, number = _numbered(lines, run, keys, limit)
    together = max(1, min(-(-number // PART_TASKS), TASK_BYTES // limit))
    suffix = f".{extension}" + (".gz" if compress else "")
    name = F.concat(F.lit(stem), F.lpad(F.col("part").cast("string"), 12, "0"), F.lit(suffix))
    (
        parts.withColumn("part_file", name)
        .repartitionById(-(-max(number, 1) // together), F.expr(f"cast(part div {together} as int)"))
        .sortWithinPartitions("part_file", *keys)
        .select("value", "part_file")
        .write.option("compression", "gzip" if compress else "none")
        .partitionBy("part_file")
        .text(path)
    )


def manifest_lines(keys: DataFrame, column: str) -> DataFrame:
    """Object keys as minimally quoted CSV lines."""

    key = col(column)
    quoted = F.concat(F.lit('"'), F.replace(key, F.lit('"'), F.lit('""')), F.lit('"'))
    return keys.select(F.when(key.rlike('[",\r\n]'), quoted).otherwise(key).alias("value"))


def manifest_check(keys: DataFrame, column: str) -> DataFrame:
    """One row: number of keys, keys that are not valid UTF-8, bytes of the manifest."""

    key = col(column)
    quoted = key.rlike('[",\r\n]')
    extra = F.when(quoted, 2 + F.length(key) - F.length(F.replace(key, F.lit('"'), F.lit("")))).otherwise(0)
    return keys.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(~F.is_valid_utf8(key)).alias("n_invalid"),
        F.coalesce(F.sum(F.octet_length(key) + extra + 2), F.lit(0)).cast("bigint").alias("n_bytes"),
    )


def transfer_manifest(keys: DataFrame, column: str, path: str) -> None:
    """CSV of object keys without a header. Every key must be valid UTF-8 and the total at most 1 GiB.

    A transfer service takes one file, so once the check has shown at most 1 GiB one task writes it.
    """

    check = manifest_check(keys, column).first()
    if check["n_invalid"]:
        raise ValueError(f"{check['n_invalid']} keys are not valid UTF-8")
    if check["n_bytes"] > MANIFEST_BYTES:
        raise ValueError(f"manifest has {check['n_bytes']} bytes, at most {MANIFEST_BYTES} are allowed")
    manifest_lines(keys, column).repartition(1).write.option("lineSep", "\r\n").text(path)
