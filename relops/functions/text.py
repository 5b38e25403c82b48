"""Regular-expression replacement in text columns and text files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.columns import col


def java_replacement(replacement: str) -> str:
    r"""A replacement written with ``\1`` or ``\g<name>`` in the JVM's ``$1`` and ``${name}`` notation."""

    text = replacement.replace("$", r"\$")
    text = re.sub(r"\\g<(\d+)>|\\(\d+)", lambda m: "$" + (m.group(1) or m.group(2)), text)
    return re.sub(r"\\g<([A-Za-z]\w*)>", r"${\1}", text)


def replace_in(text: Column, pattern: str, replacement: str) -> Column:
    r"""All matches replaced; ``\w``, ``\d``, ``\s`` and ``\b`` cover all of Unicode."""

    classes = "(?U)" if re.search(r"\\[wWdDsSbB]", pattern) else ""
    return F.regexp_replace(text, classes + pattern, java_replacement(replacement))


def replace_text(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    """All matches of ``pattern`` in a column replaced."""

    return df.withColumn(column, replace_in(col(column), pattern, replacement))


def replace_in_files(
    spark: SparkSession, src: str | list[str], dst: str, pattern: str, replacement: str, compression: str = "none"
) -> None:
    """Text files (plain or gz) rewritten line by line into a new folder."""

    lines = spark.read.text(src)
    replace_text(lines, "value", pattern, replacement).write.option("compression", compression).text(dst)


def gunzip_files(spark: SparkSession, src: str | list[str], dst: str) -> None:
    """The ``.gz`` text files among ``src`` written uncompressed to ``dst``."""

    lines = spark.read.option("pathGlobFilter", "*.gz").text(src)
    lines.write.option("compression", "none").text(dst)
