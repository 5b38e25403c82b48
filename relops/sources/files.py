"""CSV, JSON-lines and XML releases, and file listings."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import col

Paths = str | Sequence[str]


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """The file each row was read from."""

    return df.withColumn(name, F.col("_metadata.file_path"))


# Texts that stand for a missing value in files read without a schema.
MISSING_TEXTS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _blank_missing(df: DataFrame) -> DataFrame:
    """Not-a-number and the texts for it as nulls."""

    def present(f: T.StructField) -> Column:
        value = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.nanvl(value, F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            value = F.when(~value.isin(*MISSING_TEXTS), value)
        return value.alias(f.name)

    return df.select(*map(present, df.schema.fields))


def scan_csv(
    spark: SparkSession,
    paths: Paths,
    schema: T.StructType | None = None,
    *,
    sep: str = ",",
    quote: str = '"',
    multiline: bool = False,
    skip_rows: int = 0,
) -> DataFrame:
    """CSV files, plain or gz. With a schema, bad values fail the job; without, header row and inferred types.

    Quoted newlines (``multiline``) make a file one task, so they are off unless asked for.
    """

    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "FAILFAST"}
    reader = spark.read.options(**options).option("multiLine", multiline)
    if schema is None:
        return _blank_missing(reader.option("header", True).option("inferSchema", True).csv(_paths(paths)))
    if skip_rows <= 1:
        return reader.option("header", skip_rows == 1).option("enforceSchema", True).schema(schema).csv(_paths(paths))
    if multiline:
        raise ValueError("quoted newlines and more than one skipped row cannot be combined")

    lines = spark.read.text(_paths(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    body = lines.mapInArrow(_without_first(skip_rows), "value string").filter(F.length("value") > 0)
    return body.select(F.from_csv("value", _ddl(schema), options).alias("row")).select("row.*")


def _without_first(count: int):
    """Lines but the first ``count`` of each file. Those stand in its first block, whose lines one task reads in order."""

    def work(batches):
        file, seen = None, 0
        for batch in batches:
            begins = np.asarray(batch["block"]) == 0
            files = batch["file"].dictionary_encode()
            number = files.indices.to_numpy(zero_copy_only=False)
            keep = np.ones(batch.num_rows, bool)
            opens = np.flatnonzero(np.concatenate([np.ones(min(len(number), 1), bool), number[1:] != number[:-1]]))
            for begin, end in zip(opens, [*opens[1:], len(number)]):
                name = files.dictionary[number[begin]].as_py()
                if name != file:
                    file, seen = name, 0
                if begins[begin]:
                    keep[begin : min(end, begin + max(count - seen, 0))] = False
                seen += end - begin
            yield pa.RecordBatch.from_arrays([batch["value"].filter(pa.array(keep))], ["value"])

    return work


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def unknown_json_fields(text: Column, schema: T.StructType, above: str = "") -> Column:
    """Field paths of a JSON object that ``schema`` lacks, in a text column.

    Text, map and variant fields hold objects of any shape. What is no object has no fields.
    """

    fields = F.from_json(text, "map<string,string>")
    extra = F.array_except(F.map_keys(fields), F.array(*[F.lit(f.name) for f in schema.fields]).cast("array<string>"))
    found = [F.transform(extra, lambda name: F.concat(F.lit(above), name))]
    for f in schema.fields:
        value, path, dtype = F.try_element_at(fields, F.lit(f.name)), f"{above}{f.name}.", f.dataType
        if isinstance(dtype, T.StructType):
            found.append(unknown_json_fields(value, dtype, path))
        elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            found.append(F.flatten(F.transform(F.from_json(value, "array<string>"), _unknown_in(dtype.elementType, path))))
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(one, none) for one in found])


def _unknown_in(schema: T.StructType, above: str):
    return lambda one: unknown_json_fields(one, schema, above)


def unknown_fields(spark: SparkSession, paths: Paths, schema: T.StructType) -> list[str]:
    """Field paths that occur in JSON-lines files but not in ``schema``, one pass over the text."""

    lines = spark.read.text(_paths(paths)).filter(F.length(F.trim("value")) > 0)
    found = lines.select(F.explode(unknown_json_fields(F.col("value"), schema)).alias("path")).distinct()
    return [r["path"] for r in found.orderBy("path").collect()]


def scan_jsonl(
    spark: SparkSession, paths: Paths, schema: T.StructType | None = None, *, ignore_unknown: bool = False
) -> DataFrame:
    """JSON-lines files, plain or gz. Bad types fail the job, and so do fields outside the schema unless ignored.

    Fields are checked in the pass that reads the rows: nothing is inferred and the files are read once.
    """

    reader = spark.read.option("mode", "FAILFAST")
    if schema is None:
        return reader.json(_paths(paths))
    if ignore_unknown:
        return reader.schema(schema).json(_paths(paths))
    lines = spark.read.text(_paths(paths))
    rest = [c for c in lines.columns if c != "value"]
    extra = unknown_json_fields(F.col("value"), schema)
    refused = F.raise_error(F.concat(F.lit("fields not in the schema: "), F.array_join(F.col("extra"), ", ")))
    row = F.when(F.size("extra") > 0, refused).otherwise(F.from_json("value", schema, {"mode": "FAILFAST"}))
    rows = lines.filter(F.length(F.trim("value")) > 0).withColumn("extra", extra)
    return rows.select(row.alias("row"), *map(col, rest)).select("row.*", *map(col, rest))


def scan_xml(df: DataFrame, column: str, schema: T.StructType | str, name: str = "record") -> DataFrame:
    """XML documents in a string column as nested records; attributes are ``@name``, text beside them ``#text``."""

    options = {"attributePrefix": "@", "valueTag": "#text", "mode": "FAILFAST"}
    return df.withColumn(name, F.from_xml(col(column), schema, options))


def scan_xml_files(spark: SparkSession, paths: Paths, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Elements ``row_tag`` of XML files as rows."""

    reader = spark.read.format("xml").options(rowTag=row_tag, attributePrefix="@", valueTag="#text", mode="FAILFAST")
    return reader.schema(schema).load(_paths(paths))


def base_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def glob_pattern(glob: str) -> str:
    """Regular expression of an object-store glob: ``*`` and ``?`` stop at slashes, ``**`` does not."""

    def piece(m: re.Match) -> str:
        token = m.group(0)
        if token == "**":
            return ".*"
        if token in ("*", "?"):
            return "[^/]*" if token == "*" else "[^/]"
        if token.startswith("{"):
            return "(?:" + "|".join(map(re.escape, token[1:-1].split(","))) + ")"
        if token.startswith("["):
            return token.replace("[!", "[^", 1)
        return re.escape(token)

    return "^" + re.sub(r"\*\*|\*|\?|\{[^}]*\}|\[[^\]]*\]|.", piece, glob, flags=re.S) + "$"


def select_keys(
    listing: DataFrame, key: str = "path", *, regex: str | None = None, prefix: str | None = None, glob: str | None = None
) -> DataFrame:
    """Rows of a listing by regex at the start of the base name, by key prefix, by glob on the whole key."""

    if regex is not None:
        listing = listing.filter(base_name(col(key)).rlike(f"^(?:{regex})"))
    if prefix is not None:
        listing = listing.filter(col(key).startswith(prefix))
    if glob is not None:
        listing = listing.filter(col(key).rlike(glob_pattern(glob)))
    return listing


def list_files(
    spark: SparkSession,
    path: str,
    *,
    regex: str | None = None,
    prefix: str | None = None,
    glob: str | None = None,
    modified_since: dt.datetime | None = None,
    modified_before: dt.datetime | None = None,
) -> DataFrame:
    """Files below ``path`` with key, length and modification time; file contents are never read."""

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if modified_since:
        reader = reader.option("modifiedAfter", modified_since.strftime("%Y-%m-%dT%H:%M:%S"))
    if modified_before:
        reader = reader.option("modifiedBefore", modified_before.strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    # Spark shows qualified paths, so the qualified root's length is what a key lacks.
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    below = F.substring("path", len(root) + 2, 1 << 30)
    keyed = files.withColumn("key", below)
    return select_keys(keyed, "key", regex=regex, prefix=prefix, glob=glob)
