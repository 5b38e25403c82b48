"""Schema files: JSON field lists, versions dated in the file name, and checks of data against them."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import ColumnMismatch, col
from relops.functions.nested import field_paths
from relops.operators.asof import asof_join

# Type names of schema files and the Spark types that hold them.
FIELD_TYPES = {
    "STRING": T.StringType(),
    "INTEGER": T.LongType(),
    "INT64": T.LongType(),
    "FLOAT": T.DoubleType(),
    "FLOAT64": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "BOOL": T.BooleanType(),
    "NUMERIC": T.DecimalType(38, 9),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "DATETIME": T.TimestampNTZType(),
    "TIME": T.StringType(),
    "BYTES": T.BinaryType(),
    "JSON": T.VariantType(),
}
RECORD_TYPES = ("RECORD", "STRUCT")


def _field(spec: dict) -> T.StructField:
    kind = spec["type"].upper()
    mode = spec.get("mode", "NULLABLE").upper()
    if kind in RECORD_TYPES:
        dtype = schema_from_fields(spec["fields"])
    elif kind in FIELD_TYPES:
        dtype = FIELD_TYPES[kind]
    else:
        raise ValueError(f"unknown type {spec['type']} of field {spec['name']}")
    if mode == "REPEATED":
        dtype = T.ArrayType(dtype)
    metadata = {"comment": spec["description"]} if spec.get("description") else {}
    return T.StructField(spec["name"], dtype, mode != "REQUIRED", metadata)


def schema_from_fields(fields: list[dict]) -> T.StructType:
    return T.StructType([_field(f) for f in fields])


def schema_from_json(spark: SparkSession, path: str) -> T.StructType:
    """Spark schema of a JSON schema file (one small file, wherever Hadoop can read it)."""

    text = spark.read.option("wholetext", True).text(path).first()[0]
    return schema_from_fields(json.loads(text))


def required_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Null count of every REQUIRED top-level column, in one pass: rows (column_name, n_null)."""

    required = [f.name for f in schema.fields if not f.nullable]
    counts = df.agg(*[F.count_if(col(n).isNull()).alias(f"c{i}") for i, n in enumerate(required)])
    pairs = [F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("n_null")) for i, n in enumerate(required)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_name string, n_null bigint")
    return counts.select(F.inline(F.array(*pairs)))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``.

    Missing nullable columns become null, unknown columns and other types are errors, and a null in a REQUIRED
    column fails the job that reads it. No extra pass over the data.
    """

    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ColumnMismatch(f"columns not in the schema: {', '.join(unknown)}")

    def checked(field: T.StructField) -> Column:
        if field.name not in df.columns:
            if not field.nullable:
                raise ColumnMismatch(f"required column {field.name} is missing")
            return F.lit(None).cast(field.dataType)
        found = df.schema[field.name].dataType
        if found.simpleString() != field.dataType.simpleString():
            raise ColumnMismatch(
                f"column {field.name} is {found.simpleString()}, the schema says {field.dataType.simpleString()}"
            )
        if field.nullable:
            return col(field.name)
        missing = F.raise_error(F.lit(f"null in required column {field.name}"))
        return F.coalesce(col(field.name), missing.cast(field.dataType))

    return df.select(*[checked(f).alias(f.name, metadata=f.metadata) for f in schema.fields])


def column_paths(df: DataFrame) -> DataFrame:
    """One row per field path and type, in schema order."""

    rows = [(i, path, dtype) for i, (path, dtype) in enumerate(field_paths(df.schema))]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string")


def find_schema(
    files: DataFrame, table: str, release_date: dt.date | None = None, prefix: str = ""
) -> str | None:
    """Path of the schema file for a table out of a listing with a ``path`` column.

    Without a date the undated file. With one, the newest file dated no later; never the undated one.
    """

    name = F.substring_index(F.col("path"), "/", -1)
    stem = re.escape(prefix + table)
    if release_date is None:
        hits = files.filter(name.rlike(f"^{stem}[.]json$")).agg(F.min("path").alias("path"))
    else:
        version = F.try_to_date(F.regexp_extract(name, f"^{stem}_([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})[.]json$", 1))
        dated = files.select("path", version.alias("version")).filter(F.col("version") <= F.lit(release_date))
        hits = dated.agg(F.max_by("path", F.struct("version", "path")).alias("path"))
    return hits.first()["path"]


def schema_as_of(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """For many (table_name, release_date) requests the newest (table_name, version, path) no later; else null."""

    found = asof_join(
        requests, versions, by="table_name", left_time="release_date", right_time="version", value=F.struct("version", "path")
    )
    return found.select("table_name", "release_date", F.col("latest.path").alias("path"))
