"""Catalog tables: guarded reads, inventory and date shards."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.columns import col
from relops.operators.shards import shards_of
from relops.versions import finish_swap, folder_of, table_facts, table_properties

EXPIRES_AT = "relops.expires_at"
REQUIRE_FILTER = "relops.require_partition_filter"
PARTITION_FIELD = "relops.partition_field"
PARTITION_KIND = "relops.partition_kind"
# The column that numbers the groups of a table grouped by its merge keys.
GROUP, GROUP_BY = "relops_group", "relops.group_by"


class TableMissing(LookupError):
    """No such table, or it has expired."""


class PartitionFilterRequired(ValueError):
    """A table that must be read by partition was read whole."""


def _expired(properties: dict[str, str], now: dt.datetime | None) -> bool:
    stamp = properties.get(EXPIRES_AT)
    now = now or dt.datetime.now(dt.timezone.utc)
    return stamp is not None and dt.datetime.fromisoformat(stamp) <= now


def table_exists(spark: SparkSession, name: str, now: dt.datetime | None = None) -> bool:
    """Whether the table exists and has not expired; a replacement that was cut short is finished first."""

    return (spark.catalog.tableExists(name) or finish_swap(spark, name)) and not _expired(table_properties(spark, name), now)


def partition_column(field: str, kind: str) -> str:
    return f"{field}_{kind.lower()}"


# How a partition is named for each kind.
PARTITION_FORMATS = {"HOUR": "yyyy-MM-dd HH", "DAY": "yyyy-MM-dd", "MONTH": "yyyy-MM", "YEAR": "yyyy"}


def partition_value(ts: Column, kind: str) -> Column:
    return F.date_format(ts, PARTITION_FORMATS[kind])


def without_partition_column(table: DataFrame, properties: dict[str, str]) -> DataFrame:
    """The table without the column that only names its partitions."""

    if GROUP_BY in properties:
        return table.drop(GROUP)
    field = properties.get(PARTITION_FIELD)
    return table.drop(partition_column(field, properties[PARTITION_KIND])) if field else table


def read_table(
    spark: SparkSession,
    name: str,
    *,
    start: dt.datetime | dt.date | None = None,
    end: dt.datetime | dt.date | None = None,
    now: dt.datetime | None = None,
) -> DataFrame:
    """A catalog table. ``start`` (inclusive) and ``end`` (exclusive) bound the partition field of a partitioned
    table and prune its partitions; a table that demands a filter cannot be read without one.
    """

    if not table_exists(spark, name, now):
        raise TableMissing(name)
    properties = table_properties(spark, name)
    table = spark.table(name)
    field = properties.get(PARTITION_FIELD)
    if field is None:
        if start is not None or end is not None:
            raise ValueError(f"{name} is not partitioned by time")
        return without_partition_column(table, properties)
    if start is None and end is None:
        if properties.get(REQUIRE_FILTER) == "true":
            raise PartitionFilterRequired(f"{name} must be read with bounds on {field}")
        return without_partition_column(table, properties)
    kind = properties[PARTITION_KIND]
    part = col(partition_column(field, kind))
    kinds = table.schema[field].dataType
    if start is not None:
        low = F.lit(start).cast(kinds)
        table = table.filter((part >= partition_value(low, kind)) & (col(field) >= low))
    if end is not None:
        high = F.lit(end).cast(kinds)
        table = table.filter((part <= partition_value(high, kind)) & (col(field) < high))
    return without_partition_column(table, properties)


def stored_facts(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """For each table whether it exists, its rows, and the bytes of the files that hold them, all in one job.

    Columns ``table_id``, ``exists``, ``n_rows``, ``n_bytes``. No column is read: row counts come from file footers.
    A missing or expired table has no numbers; of a view, and of a table that is not Parquet, the rows alone are known.
    """

    parts = [spark.createDataFrame([], FACTS)]
    for name in dict.fromkeys(names):
        if not table_exists(spark, name):
            parts.append(spark.range(1).select(F.lit(name), F.lit(False), F.lit(None).cast("long"), F.lit(None).cast("long")))
            continue
        # The first row of each file stands for its bytes.
        size = F.sum(F.when(F.col("_metadata.row_index") == 0, F.col("_metadata.file_size")).otherwise(0))
        parquet = table_facts(spark, name).get("Provider", "").lower() == "parquet"
        n_bytes = F.coalesce(size, F.lit(0)) if parquet else F.lit(None)
        counted = spark.table(name).agg(F.count(F.lit(1)).alias("n_rows"), n_bytes.cast("long").alias("n_bytes"))
        parts.append(counted.select(F.lit(name), F.lit(True), "n_rows", "n_bytes"))
    return reduce(DataFrame.union, parts)


FACTS = "table_id string, exists boolean, n_rows bigint, n_bytes bigint"


def table_inventory(spark: SparkSession, schema: str, prefix: str = "", *, statistics: bool = False) -> DataFrame:
    """Tables of a schema whose name starts with ``prefix``: id, rows, bytes, created, expiry.

    Metadata only: rows and bytes are those the catalog has, or null. With ``statistics`` both are those of the files
    now, for all tables in one job (:func:`stored_facts`); expired tables and views have none.
    """

    catalog, database = ([spark.catalog.currentCatalog()] + schema.split("."))[-2:]
    rows = []
    for table in spark.catalog.listTables(f"{catalog}.{database}"):
        if table.isTemporary or not table.name.startswith(prefix):
            continue
        name = f"{catalog}.{database}.{table.name}"
        facts = table_facts(spark, name)
        size = dict(
            (word.split()[1], int(word.split()[0])) for word in facts.get("Statistics", "").split(", ") if word.strip()
        )
        expires = None if table.tableType == "VIEW" else table_properties(spark, name).get(EXPIRES_AT)
        rows.append((name, table.tableType, size.get("rows"), size.get("bytes"), facts.get("Created Time"), expires))
    listing = spark.createDataFrame(
        rows, "table_id string, table_type string, n_rows bigint, n_bytes bigint, created string, expires_at string"
    )
    if statistics:
        facts = stored_facts(spark, [r[0] for r in rows if r[1] != "VIEW"]).drop("exists")
        listing = listing.drop("n_rows", "n_bytes").join(facts, "table_id", "left")
        listing = listing.select("table_id", "table_type", "n_rows", "n_bytes", "created", "expires_at")
    # Written like "Mon Jan 01 12:00:00 UTC 2024"; the reader takes no weekday.
    created = F.try_to_timestamp(F.regexp_replace("created", "^[A-Za-z]+ ", ""), F.lit("MMM d HH:mm:ss zzz yyyy"))
    return listing.withColumn("created", created).withColumn("expires_at", F.col("expires_at").cast("timestamp"))


def schema_inventory(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Schemas whose name starts with ``prefix``: name, number of tables, and when they were made.

    The catalog knows no time for a schema: it is that of its oldest table, without any the last change of its folder,
    and null where there is none. Metadata only.
    """

    rows = []
    for name in list_schemas(spark, prefix):
        tables = table_inventory(spark, name).agg(F.count(F.lit(1)).alias("n"), F.min("created").alias("first")).first()
        made = tables["first"]
        if made is None:
            files, folder = folder_of(spark, spark.catalog.getDatabase(name).locationUri)
            if files.exists(folder):
                made = dt.datetime.fromtimestamp(files.getFileStatus(folder).getModificationTime() / 1000, dt.timezone.utc)
        rows.append((name, tables["n"], made))
    return spark.createDataFrame(rows, "name string, n_tables bigint, created timestamp")


def list_schemas(spark: SparkSession, prefix: str = "") -> list[str]:
    return [d.name for d in spark.catalog.listDatabases() if d.name.startswith(prefix)]


def table_names(spark: SparkSession, schema: str) -> DataFrame:
    """Table ids of a schema, as a listing the shard operators take."""

    catalog, database = ([spark.catalog.currentCatalog()] + schema.split("."))[-2:]
    names = [(f"{catalog}.{database}.{t.name}",) for t in spark.catalog.listTables(f"{catalog}.{database}")]
    return spark.createDataFrame(names, "table_id string")


def scan_shards(
    spark: SparkSession, base: str, start: dt.date | None = None, end: dt.date | None = None, name: str = "shard_date"
) -> DataFrame:
    """All tables ``base`` + YYYYMMDD, the date as a column; shards outside the bounds never enter the plan."""

    found = shards_of(table_names(spark, base.rsplit(".", 1)[0]), base)
    if start is not None:
        found = found.filter(F.col("shard_date") >= F.lit(start))
    if end is not None:
        found = found.filter(F.col("shard_date") <= F.lit(end))
    dates = sorted(r["shard_date"] for r in found.collect())
    if not dates:
        raise TableMissing(f"no shards of {base}")
    shards = [spark.table(f"{base}{d:%Y%m%d}").withColumn(name, F.lit(d)) for d in dates]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
