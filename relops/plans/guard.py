"""Checks of a query before it runs: what it would read, and that it filters the tables that demand it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.sizing import read_bytes, scan_leaves
from relops.sources.tables import REQUIRE_FILTER, PartitionFilterRequired
from relops.versions import table_properties

# Fixed value: bytes one query may scan by default.
DEFAULT_BUDGET = 2 * 2**40


class BudgetExceeded(RuntimeError):
    """A query would scan more than it may."""


def estimate_bytes(spark: SparkSession, sql: str, args: dict | None = None) -> int:
    """Bytes a query would scan; nothing is run."""

    return read_bytes(spark.sql(sql, args=args) if args else spark.sql(sql))


def check_budget(bytes_budget: int, bytes_estimate: int) -> None:
    """Refuse an estimate above the budget; equal passes. Both must be whole numbers."""

    for label, value in (("bytes_budget", bytes_budget), ("bytes_estimate", bytes_estimate)):
        if not isinstance(value, int):
            raise TypeError(f"{label} must be an integer, not {value!r}")
    if bytes_estimate > bytes_budget:
        raise BudgetExceeded(f"estimate of {bytes_estimate} bytes exceeds the budget of {bytes_budget}")


def check_filters(df: DataFrame) -> None:
    """Refuse a query that scans a table which must be read by partition without a filter on its partitions."""

    spark = df.sparkSession
    for leaf in scan_leaves(df):
        if leaf.getClass().getSimpleName() != "FileSourceScanExec" or leaf.tableIdentifier().isEmpty():
            continue
        name = leaf.tableIdentifier().get().quotedString()
        if leaf.partitionFilters().isEmpty() and table_properties(spark, name).get(REQUIRE_FILTER) == "true":
            raise PartitionFilterRequired(f"{name} must be read with a filter on its partitions")


def guarded_query(
    spark: SparkSession, sql: str, args: dict | None = None, bytes_budget: int = DEFAULT_BUDGET
) -> DataFrame:
    """A query's DataFrame, once it filters the tables that demand it and its estimate is within the budget."""

    df = spark.sql(sql, args=args) if args else spark.sql(sql)
    check_filters(df)
    check_budget(bytes_budget, read_bytes(df))
    return df


def run_template(spark: SparkSession, sql: str, args: dict | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """SQL text with named parameters (``:name``, ``IDENTIFIER(:name)``) and ``{table}`` placeholders for DataFrames.

    A table that must be read by partition needs a filter here too.
    """

    df = spark.sql(sql, args=args, **(tables or {}))
    check_filters(df)
    return df


def budget_report(queries: dict[str, DataFrame], bytes_budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Estimate and verdict for each query."""

    spark = next(iter(queries.values())).sparkSession
    rows = [(name, read_bytes(df)) for name, df in queries.items()]
    report = spark.createDataFrame(rows, "query string, bytes_estimate bigint")
    return report.withColumn("within_budget", F.col("bytes_estimate") <= F.lit(bytes_budget))
