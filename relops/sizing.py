"""Sizes taken from a query's plan before it runs."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Leaves that hold values of the query itself and read nothing.
CONSTANT_LEAVES = ("OneRowRelation", "LocalRelation", "Range", "LogicalRDD")

# Spark states a size near the largest long where it knows none (a partitioned table never analysed).
UNKNOWN_BYTES = 2**60

# Physical leaves that read nothing, or what is held in memory already.
MEMORY_LEAVES = ("LocalTableScanExec", "RDDScanExec", "RangeExec", "OneRowRelationExec", "InMemoryTableScanExec", "CommandResultExec", "EmptyRelationExec", "ReusedSubqueryExec")
# Footers read to know how a table's bytes are shared by its columns; exact up to so many files.
SAMPLED_FILES = 64

# Scanned bytes one range partition should stand for; compressed columns grow several times over in a shuffle.
BYTES_PER_PARTITION = 64 * 1024**2
MOST_PARTITIONS = 100_000


def scan_bytes(df: DataFrame) -> int:
    """Bytes the query's scans are estimated to read: each leaf of the optimized plan, after column pruning.

    A file leaf counts its files left after partition pruning, scaled to the share of the columns it reads.
    """

    total = 0
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        link = leaf.logicalLink()
        if link.isEmpty():
            continue
        if link.get().nodeName() in CONSTANT_LEAVES:
            continue
        size = int(str(link.get().stats().sizeInBytes()))
        if leaf.getClass().getSimpleName() == "FileSourceScanExec":
            width = leaf.relation().dataSchema().defaultSize()
            size = size * leaf.requiredSchema().defaultSize() // max(width, 1)
        total += size
    return total


def range_partitions(df: DataFrame) -> int:
    """Number of range partitions for a global sort of ``df``: by what it scans, at least one per core.

    Where nothing is known of the size, as for a checkpointed DataFrame, the session's shuffle setting counts.
    """

    spark = df.sparkSession
    scanned = scan_bytes(df)
    if scanned == 0 or scanned >= UNKNOWN_BYTES:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(MOST_PARTITIONS, -(-scanned // BYTES_PER_PARTITION)))


def read_bytes(df: DataFrame) -> int:
    """Bytes of the columns that a query's scans read, in all its subqueries too, by the footers of its files.

    Parquet files left after partition pruning count with the stored size of the columns read, struct fields on their
    own; of more than ``SAMPLED_FILES`` files an even sample is read and scaled. Files of other formats count whole.
    What nothing is known of counts as ``UNKNOWN_BYTES``.
    """

    return sum(_leaf_bytes(df.sparkSession, leaf) for leaf in scan_leaves(df))


def scan_leaves(df: DataFrame) -> Iterator:
    """The physical leaves of a query and of all its subqueries."""

    return _leaves(df._jdf.queryExecution().executedPlan())


def _leaves(plan) -> Iterator:
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from _leaves(plan.initialPlan())
        return
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            yield from _leaves(leaf)
        else:
            yield leaf
    inner = plan.subqueriesAll()
    for i in range(inner.size()):
        yield from _leaves(inner.apply(i))


def _leaf_bytes(spark: SparkSession, leaf) -> int:
    name = leaf.getClass().getSimpleName()
    if name in MEMORY_LEAVES:
        return 0
    if name != "FileSourceScanExec":
        return UNKNOWN_BYTES
    files = list(leaf.relation().location().inputFiles())
    if not files:
        return 0
    step = max(1, -(-len(files) // SAMPLED_FILES))
    sample = files[::step]
    if leaf.relation().fileFormat().toString() != "Parquet":
        return _scaled(sum(_file_size(spark, f) for f in sample), len(sample), len(files))
    wanted = _paths(T.StructType.fromJson(json.loads(leaf.requiredSchema().json())))
    return _scaled(sum(_column_size(spark, f, wanted) for f in sample), len(sample), len(files))


def _scaled(size: int, sampled: int, files: int) -> int:
    return size if sampled == files else size * files // sampled


def _paths(schema: T.StructType, above: str = "") -> list[str]:
    """Columns of a read schema as files name them: a struct by its fields, all else whole."""

    found = []
    for field in schema.fields:
        name = f"{above}{field.name}"
        found += _paths(field.dataType, f"{name}.") if isinstance(field.dataType, T.StructType) else [name]
    return found


def _hadoop_path(spark: SparkSession, uri: str):
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))


def _file_size(spark: SparkSession, uri: str) -> int:
    path = _hadoop_path(spark, uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()


def _column_size(spark: SparkSession, uri: str, wanted: Sequence[str]) -> int:
    parquet = spark._jvm.org.apache.parquet.hadoop
    file = parquet.util.HadoopInputFile.fromPath(_hadoop_path(spark, uri), spark._jsc.hadoopConfiguration())
    reader = parquet.ParquetFileReader.open(file)
    try:
        total = 0
        for block in reader.getFooter().getBlocks():
            for column in block.getColumns():
                path = column.getPath().toDotString()
                if any(path == w or path.startswith(f"{w}.") for w in wanted):
                    total += column.getTotalSize()
        return total
    finally:
        reader.close()
