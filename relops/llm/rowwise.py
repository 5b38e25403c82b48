"""Columns computed from whole Arrow batches of one text column, with any other columns carried along."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.columns import col


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of at most ``BATCH_ROWS`` rows: a batch of long texts is held several times."""

    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def annotate(
    docs: DataFrame, text_col: str, compute: Callable[[pa.Array], list[pa.Array]], fields: Sequence[tuple[str, str]], keep: Sequence[str]
) -> DataFrame:
    """Columns ``keep`` of each row and the columns ``fields`` (name, type) that ``compute`` makes of its texts.

    A kept column with the name of a new one is replaced by it. One pass, no shuffle.
    """

    names = [name for name, _ in fields]
    keep = [name for name in keep if name not in names]
    carries = text_col in keep and dict(docs.dtypes)[text_col] == "string"
    rows = docs.select(
        F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(None).cast("int").alias("none")).alias("row"),
        (F.lit(None).cast("string") if carries else col(text_col).cast("string")).alias("text"),
    )
    place = keep.index(text_col) if carries else None
    row_type = rows.schema["row"].dataType.simpleString()
    made_type = "struct<" + ",".join(f"c{i}:{kind}" for i, (_, kind) in enumerate(fields)) + ">"

    def work(batches):
        for batch in batches:
            row = batch["row"]
            made = compute(batch["text"] if place is None else row.field(place))
            made = pa.StructArray.from_arrays(made, [f"c{i}" for i in range(len(fields))])
            yield pa.RecordBatch.from_arrays([row, made], ["row", "made"])

    out = rows.mapInArrow(work, f"row {row_type}, made {made_type}")
    return out.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"made.c{i}").alias(c) for i, c in enumerate(names)]
    )
