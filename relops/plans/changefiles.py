"""Change files merged as files: JSON lines in, JSON lines out."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.operators.incremental import merge_changefiles
from relops.sinks.retention import delete_prefix
from relops.versions import folder_of

# Paths without a host are written with one slash or three.
NO_HOST = "^([A-Za-z0-9+.-]+):///"


def changefile_lines(spark: SparkSession, paths: Sequence[str], key: str) -> DataFrame:
    """Lines of change files given in order: the text, its key as JSON, the number of its file, and its place there.

    Each path is a file or a folder of files. All are read in one scan, whatever their number; ``place`` (file, where
    its block begins, line of the task) puts the lines of one number into their order. A line without the key fails
    the job; a null key is a key.
    """

    given = [(_file_uri(spark, path), i) for i, path in enumerate(paths)]
    numbers = spark.createDataFrame(given, "path string, seq int")
    file = F.col("_metadata.file_path")
    place = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(list(dict.fromkeys(paths))).select("value", place.alias("place"))
    lines = lines.filter(F.length(F.trim("value")) > 0)
    own = F.regexp_replace("place.file", NO_HOST, "$1:/")
    home = F.regexp_extract(own, "^(.*)/[^/]*$", 1)
    # One row per given path, which the driver holds anyway.
    lines = lines.withColumn("path", F.explode(F.array(own, home))).join(F.broadcast(numbers), "path").drop("path")
    name = key.replace("\\", "\\\\").replace("'", "\\'")
    found = F.to_json(F.variant_get(F.parse_json("value"), f"$['{name}']", "variant"))
    missing = F.raise_error(F.concat(F.lit(f"no {key} in line: "), F.col("value"))).cast("string")
    return lines.withColumn("key", F.coalesce(found, missing))


def _file_uri(spark: SparkSession, path: str) -> str:
    """A path as file metadata spells it."""

    files, folder = folder_of(spark, path)
    return re.sub(NO_HOST, r"\1:/", files.makeQualified(folder).toUri().toString().rstrip("/"))


def merge_changefile_texts(
    spark: SparkSession, paths: Sequence[str], key: str, target: str, delete_inputs: bool = False
) -> None:
    """Lines of the last file per key written to ``target`` unchanged, in file order and each file's lines in theirs.

    Inputs are deleted on request.
    """

    last = merge_changefiles(changefile_lines(spark, paths, key), "key", "seq")
    order = ["seq", "place.file", "place.block", "place.line"]
    placed = last.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("value").write.text(target)
    if delete_inputs:
        for path in paths:
            delete_prefix(spark, path)
