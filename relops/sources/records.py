"""Records held in memory."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import ColumnMismatch
from relops.session import scratch_path


def records_to_df(
    spark: SparkSession, records: Iterable[dict], schema: T.StructType | None = None, *, ignore_unknown: bool = False
) -> DataFrame:
    """Driver-side dicts as a DataFrame, typed by ``schema`` or by JSON inference."""

    records = list(records)
    if schema is not None and not ignore_unknown:
        extra = sorted({k for r in records for k in r} - set(schema.names))
        if extra:
            raise ColumnMismatch(f"fields not in the schema: {', '.join(extra)}")
    lines = spark.createDataFrame([(json.dumps(r, default=str),) for r in records], "value string")
    if schema is None:
        path = scratch_path(spark, "records")
        lines.write.text(path)
        return spark.read.option("mode", "FAILFAST").json(path)
    return json_records(lines, "value", schema)


def json_records(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """JSON text rows as typed rows; bad types fail, a null in a required field fails."""

    from relops.sources.schemas import conform

    nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])
    parsed = df.select(F.from_json(column, nullable, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return conform(parsed, schema)
