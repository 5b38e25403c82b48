"""The registry: one row per release, append only."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import quote
from relops.functions.dates import from_release_timestamp, to_release_timestamp
from relops.sinks.tables import create_empty_table, save_table
from relops.sources.schemas import conform
from relops.sources.tables import table_exists

# The registry's columns and the dates releases can be ordered by.
REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("dag_id", T.StringType(), False),
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("dag_run_id", T.StringType()),
        T.StructField("data_interval_start", T.TimestampType()),
        T.StructField("data_interval_end", T.TimestampType()),
        T.StructField("snapshot_date", T.TimestampType()),
        T.StructField("partition_date", T.TimestampType()),
        T.StructField("changefile_start_date", T.TimestampType()),
        T.StructField("changefile_end_date", T.TimestampType()),
        T.StructField("sequence_start", T.DecimalType(38, 9)),
        T.StructField("sequence_end", T.DecimalType(38, 9)),
        T.StructField("extra", T.VariantType()),
        T.StructField("created", T.TimestampType(), False),
        T.StructField("modified", T.TimestampType(), False),
    ]
)
DATE_KEYS = (
    "created",
    "modified",
    "data_interval_start",
    "data_interval_end",
    "snapshot_date",
    "partition_date",
    "changefile_start_date",
    "changefile_end_date",
)


@dataclasses.dataclass(kw_only=True)
class Release:
    """One release of a dataset."""

    dag_id: str
    entity_id: str
    dag_run_id: str | None = None
    data_interval_start: dt.datetime | None = None
    data_interval_end: dt.datetime | None = None
    snapshot_date: dt.datetime | None = None
    partition_date: dt.datetime | None = None
    changefile_start_date: dt.datetime | None = None
    changefile_end_date: dt.datetime | None = None
    sequence_start: int | None = None
    sequence_end: int | None = None
    extra: dict = dataclasses.field(default_factory=dict)
    created: dt.datetime
    modified: dt.datetime

    @classmethod
    def from_row(cls, row) -> Release:
        values = {f.name: row[f.name] for f in dataclasses.fields(cls)}
        for name in DATE_KEYS:
            if values[name] is not None:
                values[name] = values[name].replace(tzinfo=dt.timezone.utc)
        for name in ("sequence_start", "sequence_end"):
            values[name] = None if values[name] is None else int(values[name])
        values["extra"] = values["extra"].toPython() if values["extra"] is not None else {}
        return cls(**values)


def release_frame(spark: SparkSession, releases: list[Release]) -> DataFrame:
    """Releases as registry rows."""

    rows = [
        tuple(json.dumps(v) if n == "extra" else _utc(v) for n, v in dataclasses.asdict(r).items()) for r in releases
    ]
    names = [f.name for f in dataclasses.fields(Release)]
    kinds = {f.name: f.dataType for f in REGISTRY_SCHEMA.fields}
    schema = T.StructType(
        [
            T.StructField(n, T.StringType() if n == "extra" or isinstance(kinds[n], T.DecimalType) else kinds[n])
            for n in names
        ]
    )
    rows = [tuple(str(v) if isinstance(v, int) else v for v in r) for r in rows]
    df = spark.createDataFrame(rows, schema)
    typed = [
        F.parse_json(n).alias(n) if n == "extra" else F.col(n).cast(kinds[n]).alias(n) for n in REGISTRY_SCHEMA.names
    ]
    return conform(df.select(*typed), REGISTRY_SCHEMA)


def _utc(value):
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return value.replace(tzinfo=dt.timezone.utc)
    return value


def _check_date_key(date_key: str) -> None:
    if date_key not in DATE_KEYS:
        raise ValueError(f"invalid date_key {date_key}, one of {', '.join(DATE_KEYS)} is needed")


def seed_registry(spark: SparkSession, table: str) -> None:
    """Create the empty registry table when it is missing."""

    if not table_exists(spark, table):
        create_empty_table(spark, table, REGISTRY_SCHEMA)


def add_release(spark: SparkSession, table: str, release: Release) -> None:
    """Append one release, creating the registry first if need be."""

    seed_registry(spark, table)
    save_table(release_frame(spark, [release]), table, "WRITE_APPEND")


def _of(registry: DataFrame, dag_id: str, entity_id: str) -> DataFrame:
    return registry.filter((F.col("dag_id") == dag_id) & (F.col("entity_id") == entity_id))


def get_releases(
    registry: DataFrame,
    dag_id: str,
    entity_id: str,
    date_key: str = "created",
    limit: int | None = None,
    tie_break: str | None = None,
) -> DataFrame:
    """Releases of one dataset, newest by ``date_key`` first; ``tie_break`` orders equal dates."""

    _check_date_key(date_key)
    order = [F.col(date_key).desc()] + ([F.col(tie_break).desc()] if tie_break else [])
    found = _of(registry, dag_id, entity_id).orderBy(*order)
    return found if limit is None else found.limit(limit)


def latest_release(
    registry: DataFrame, dag_id: str, entity_id: str, date_key: str = "created", tie_break: str | None = None
) -> Release | None:
    """The newest release of one dataset, or None."""

    row = get_releases(registry, dag_id, entity_id, date_key, 1, tie_break).first()
    return None if row is None else Release.from_row(row)


def latest_releases(registry: DataFrame, date_key: str = "created", tie_break: str | None = None) -> DataFrame:
    """The newest release of every (dag_id, entity_id). Partial maxima are combined before the shuffle."""

    _check_date_key(date_key)
    # A release without the date comes last, as in a descending sort.
    rank = F.struct(F.col(date_key).isNotNull(), F.col(date_key), *([F.col(tie_break)] if tie_break else []))
    row = F.struct(*[F.col(quote(c)) for c in registry.columns])
    return registry.groupBy("dag_id", "entity_id").agg(F.max_by(row, rank).alias("__relops_row")).select("__relops_row.*")


def is_first_release(registry: DataFrame, dag_id: str, entity_id: str) -> bool:
    """Whether the registry has no release of the dataset yet."""

    return _of(registry, dag_id, entity_id).isEmpty()


def first_releases(registry: DataFrame, datasets: DataFrame) -> DataFrame:
    """For many (dag_id, entity_id): number of releases, and whether the next would be the first."""

    pairs = ["dag_id", "entity_id"]
    counts = registry.groupBy(*pairs).agg(F.count(F.lit(1)).alias("__relops_n"))
    n = F.coalesce(F.col("__relops_n"), F.lit(0)).cast("bigint")
    return datasets.join(counts, pairs, "left").select(*pairs, n.alias("n_releases"), (n == 0).alias("is_first"))


def _field_text(f: T.StructField) -> Column:
    return from_release_timestamp(F.col(f.name)) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)


def release_to_json(registry: DataFrame, name: str = "document") -> DataFrame:
    """Registry rows plus one JSON document each, timestamps as ISO text; absent values stay as nulls."""

    fields = [_field_text(f).alias(f.name) for f in registry.schema.fields]
    return registry.withColumn(name, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def release_from_json(documents: DataFrame, column: str, schema: T.StructType = REGISTRY_SCHEMA) -> DataFrame:
    """JSON documents of releases back as typed rows; a document may hold one release or a list of them."""

    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema]
    )
    # Spark reads a single object as a list of one.
    rows = documents.select(F.inline(F.from_json(column, T.ArrayType(as_text), {"mode": "FAILFAST"})))
    return rows.select(
        *[
            to_release_timestamp(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in schema.fields
        ]
    )


def write_release_documents(documents: DataFrame, column: str, path: str, id_column: str | None = None) -> DataFrame:
    """Each document under ``path/releases/id=<id>``; ids are generated where none are given. Returns the ids."""

    from relops.staging import stage

    identity = F.col(id_column) if id_column else F.lit(None).cast("string")
    keyed = stage(documents.select(F.coalesce(identity, F.uuid()).alias("id"), F.col(column).alias("value")), "releases")
    # Documents of other ids stay, one of the same id is replaced.
    keyed.write.partitionBy("id").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(f"{path}/releases")
    return keyed.select("id")


def read_release_document(spark: SparkSession, path: str, release_id: str, schema: T.StructType = REGISTRY_SCHEMA) -> DataFrame:
    """The release (or releases) stored under one id."""

    lines = spark.read.text(f"{path}/releases/id={release_id}")
    return release_from_json(lines, "value", schema)
