"""Writing catalog tables: dispositions, partitions, clustering, copies, snapshots, views."""

from __future__ import annotations

import dataclasses
import datetime as dt
import logging
import re
import uuid
from collections.abc import Callable, Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import ColumnMismatch, as_list, col, union_all
from relops.sizing import UNKNOWN_BYTES, range_partitions, scan_bytes
from relops.sources.files import scan_csv, scan_jsonl
from relops.sources.records import records_to_df
from relops.sources.schemas import conform
from relops.sources.tables import (
    EXPIRES_AT,
    GROUP,
    GROUP_BY,
    PARTITION_FIELD,
    PARTITION_FORMATS,
    PARTITION_KIND,
    REQUIRE_FILTER,
    TableMissing,
    partition_column,
    partition_value,
    table_exists,
    without_partition_column,
)
from relops.staging import stage
from relops.versions import (
    NULL_PARTITION,
    OLD_FOLDERS,
    REPLACES,
    SHARED,
    SNAPSHOTS,
    SNAPSHOT_OF,
    file_folders,
    finish_swap,
    folder_of,
    fresh_folder,
    lines,
    location,
    note_folders,
    partition_name,
    point_partitions,
    set_properties,
    short,
    sql_text,
    swap_in,
    table_facts,
    table_properties,
    unset_properties,
)

WRITE_EMPTY, WRITE_TRUNCATE, WRITE_APPEND = "WRITE_EMPTY", "WRITE_TRUNCATE", "WRITE_APPEND"
LABEL = "relops.label."
CLUSTER_BY, BUCKET_BY, BUCKETS = "relops.cluster_by", "relops.bucket_by", "relops.buckets"
GROUPS = "relops.groups"
LAYOUT_PROPERTIES = (PARTITION_FIELD, PARTITION_KIND, REQUIRE_FILTER, CLUSTER_BY, BUCKET_BY, BUCKETS, GROUP_BY, GROUPS)
# Properties of one version or entry, not of the table as such.
ENTRY_PROPERTIES = (*LAYOUT_PROPERTIES, EXPIRES_AT, OLD_FOLDERS, REPLACES, SHARED)

# Scanned bytes that one bucket should stand for, ten times as many when its rows are sorted; Spark allows so many buckets.
BUCKET_BYTES = 16 * 1024**2
MOST_BUCKETS = 100_000

log = logging.getLogger(__name__)


class TableNotEmpty(ValueError):
    """WRITE_EMPTY found rows in the target table."""


def set_description(spark: SparkSession, name: str, description: str) -> None:
    spark.sql(f"COMMENT ON TABLE {name} IS {sql_text(description)}")


@dataclasses.dataclass(frozen=True, kw_only=True)
class Layout:
    """How a table's rows lie in files; kept with the table and applied again whenever it is rewritten.

    Partitioned by the hour, day, month or year of a field, or grouped or bucketed by merge keys, or neither; clustered
    (sorted, so that file statistics skip) by further fields. Partitions and groups are what a merge rewrites: those
    without a changed row keep their files.
    """

    partition_field: str | None = None
    partition_kind: str = "DAY"
    require_filter: bool = False
    cluster_by: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0
    group_by: tuple[str, ...] = ()
    groups: int = 0

    @classmethod
    def of(cls, properties: dict[str, str]) -> Layout:
        return cls(
            partition_field=properties.get(PARTITION_FIELD),
            partition_kind=properties.get(PARTITION_KIND, "DAY"),
            require_filter=properties.get(REQUIRE_FILTER) == "true",
            cluster_by=tuple(filter(None, properties.get(CLUSTER_BY, "").split(","))),
            bucket_by=tuple(filter(None, properties.get(BUCKET_BY, "").split(","))),
            buckets=int(properties.get(BUCKETS, "0")),
            group_by=tuple(filter(None, properties.get(GROUP_BY, "").split(","))),
            groups=int(properties.get(GROUPS, "0")),
        )

    def properties(self) -> dict[str, str]:
        found = {}
        if self.partition_field:
            found[PARTITION_FIELD] = self.partition_field
            found[PARTITION_KIND] = self.partition_kind
            found[REQUIRE_FILTER] = str(self.require_filter).lower()
        if self.cluster_by:
            found[CLUSTER_BY] = ",".join(self.cluster_by)
        if self.bucket_by:
            found[BUCKET_BY], found[BUCKETS] = ",".join(self.bucket_by), str(self.buckets)
        if self.group_by:
            found[GROUP_BY], found[GROUPS] = ",".join(self.group_by), str(self.groups)
        return found

    @property
    def part(self) -> str | None:
        """The column that names the partitions or groups."""

        if self.partition_field:
            return partition_column(self.partition_field, self.partition_kind)
        return GROUP if self.group_by else None

    def part_value(self, named: dict[str, str] | None = None) -> Column:
        """The partition or group of a row; ``named`` says what its columns are called elsewhere."""

        named = named or {}
        if self.partition_field:
            if self.partition_kind not in PARTITION_FORMATS:
                raise ValueError(f"unknown partition kind {self.partition_kind}")
            return partition_value(col(named.get(self.partition_field, self.partition_field)), self.partition_kind)
        keys = [col(named.get(k, k)) for k in self.group_by]
        return F.pmod(F.xxhash64(*keys), F.lit(self.groups)).cast("string")

    def fits(self, df: DataFrame) -> bool:
        needed = {*self.cluster_by, *self.bucket_by, *self.group_by, *([self.partition_field] if self.partition_field else [])}
        return needed <= set(df.columns)

    def buckets_of(self, df: DataFrame) -> int:
        """The layout's number of buckets, or for rows that scan much as many times that as keep a bucket bounded.

        One task writes a bucket and one reads it, sorted by the keys each time.
        """

        scanned = scan_bytes(df)
        if scanned >= UNKNOWN_BYTES:
            return self.buckets
        return self.buckets * max(1, min(MOST_BUCKETS // self.buckets, -(-scanned // (self.buckets * BUCKET_BYTES))))

    def place(self, df: DataFrame) -> DataFrame:
        """Rows where this layout wants them, the partition column added."""

        if self.part:
            # REBALANCE lets AQE split a partition value that holds many rows and merge small ones.
            df = df.withColumn(self.part, self.part_value()).hint("rebalance", self.part)
            return df.sortWithinPartitions(*map(col, [self.part, *self.cluster_by])) if self.cluster_by else df
        if self.bucket_by:
            return df.repartition(self.buckets_of(df), *map(col, self.bucket_by))
        return cluster(df, self.cluster_by) if self.cluster_by else df

    def writer(self, df: DataFrame) -> DataFrameWriter:
        writer = self.place(df).write.format("parquet")
        if self.part:
            return writer.partitionBy(self.part)
        if self.bucket_by:
            return writer.bucketBy(self.buckets_of(df), *self.bucket_by).sortBy(*self.bucket_by)
        return writer


def cluster(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows laid out by ``fields`` so that file statistics skip; a value that fills many files is spread over them.

    Only rows that agree in every plain column stay together.
    """

    rest = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in fields]
    spread = [F.xxhash64(*map(col, rest))] if rest else []
    placed = df.repartitionByRange(range_partitions(df), *map(col, fields), *spread)
    return placed.sortWithinPartitions(*map(col, fields))


def _replace(df: DataFrame, name: str, layout: Layout) -> None:
    """Write the files first, then point the catalog at them.

    The old table stays readable until the new one is complete, the query may read the table it replaces, and a
    failed job loses nothing. The old files stay for readers that opened them, until
    ``retention.drop_old_files``. Description and labels stay too.
    """

    spark = df.sparkSession
    fresh = f"{name}__{uuid.uuid4().hex[:8]}"
    layout.writer(df).option("path", fresh_folder(spark, name)).saveAsTable(fresh)
    kept, folders = {}, []
    if spark.catalog.tableExists(name):
        kept = table_properties(spark, name)
        if OLD_FOLDERS in kept:
            # Only folders that this package wrote; one of another writer may hold more than this table.
            folders = [*lines(kept[OLD_FOLDERS]), location(spark, name)]
        if comment := table_facts(spark, name).get("Comment"):
            set_description(spark, fresh, comment)
    kept = {k: v for k, v in kept.items() if k.startswith("relops.") and k not in ENTRY_PROPERTIES}
    folders = "\n".join(dict.fromkeys([*folders, location(spark, fresh)]))
    set_properties(spark, fresh, {**kept, **layout.properties(), OLD_FOLDERS: folders})
    swap_in(spark, fresh, name)
    unset_properties(spark, name, EXPIRES_AT)


def create_empty_table(
    spark: SparkSession, name: str, schema: T.StructType, exists_ok: bool = True, cluster_by: Sequence[str] = ()
) -> None:
    if spark.catalog.tableExists(name):
        if not exists_ok:
            raise TableNotEmpty(f"{name} exists")
        return
    _replace(spark.createDataFrame([], schema), name, Layout(cluster_by=tuple(cluster_by)))


def save_table(
    df: DataFrame,
    name: str,
    disposition: str = WRITE_EMPTY,
    *,
    layout: Layout | None = None,
    description: str | None = None,
    labels: dict[str, str] | None = None,
) -> None:
    """EMPTY refuses a table that has rows, TRUNCATE replaces it, APPEND adds to it (all create it when missing).

    Without a ``layout`` an existing table keeps its own.
    """

    spark = df.sparkSession
    exists = spark.catalog.tableExists(name) or finish_swap(spark, name)
    if disposition not in (WRITE_EMPTY, WRITE_TRUNCATE, WRITE_APPEND):
        raise ValueError(f"unknown disposition {disposition}")
    if disposition == WRITE_EMPTY and exists and not spark.table(name).isEmpty():
        raise TableNotEmpty(name)
    present = Layout.of(table_properties(spark, name)) if exists else Layout()
    if exists and disposition != WRITE_TRUNCATE and layout in (None, present):
        target = spark.table(name)
        logical = without_partition_column(target, table_properties(spark, name))
        rows = conform(df, _nullable(logical.schema))
        if table_properties(spark, name).get(SHARED) == "true":
            _append_aside(rows, name, present)
        else:
            present.place(rows).select(*map(col, target.columns)).write.insertInto(name)
    elif disposition == WRITE_APPEND and exists:
        raise ValueError(f"{name} has another layout")
    else:
        if layout is None:
            layout = present if present.fits(df) else Layout()
        _replace(df, name, layout)
    _note_size(spark, name)
    if description is not None:
        set_description(spark, name, description)
    set_properties(spark, name, {f"{LABEL}{k}": v for k, v in (labels or {}).items()})


def _append_aside(rows: DataFrame, name: str, layout: Layout) -> None:
    """Append to a table whose folders a snapshot shares: what the rows fall in is written anew."""

    spark = rows.sparkSession
    if layout.part is None:
        _replace(whole_table(spark, name).unionByName(rows), name, layout)
        return
    rows = stage(rows, "appended")
    values = [r[0] for r in rows.select(layout.part_value()).distinct().collect()]
    rewrite_partitions(partition_rows(spark, name, values).unionByName(rows), name, values)


def partition_rows(spark: SparkSession, name: str, values: Sequence[str | None]) -> DataFrame:
    """All rows of some partitions or groups of a table, without the column that names them."""

    properties = table_properties(spark, name)
    part = col(Layout.of(properties).part).cast("string")
    wanted = part.isin([v for v in values if v is not None])
    if None in values:
        wanted = wanted | part.isNull()
    return without_partition_column(spark.table(name).filter(wanted), properties)


def rewrite_partitions(df: DataFrame, name: str, values: Sequence[str | None] = ()) -> None:
    """Make ``df`` the rows of the partitions or groups ``values`` and of all others it has rows for.

    New files are written to a fresh folder and the partitions pointed at it, so the query may read the table; all
    other partitions keep their files. One without rows stays as an empty one, so later rows go to the new folder.
    """

    spark = df.sparkSession
    layout = Layout.of(table_properties(spark, name))
    part, folder = layout.part, fresh_folder(spark, name)
    table = spark.table(name)
    layout.place(df).select(*map(col, table.columns)).write.partitionBy(part).parquet(folder)
    note_folders(spark, name, folder)
    # Partition values only: no column of the files is read.
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == part else f.dataType) for f in table.schema.fields])
    written = {r[0] for r in spark.read.schema(schema).parquet(folder).select(part).distinct().collect()}
    for value in set(values) - written:
        files, path = folder_of(spark, f"{folder}/{partition_name(part, value)}")
        files.mkdirs(path)
    point_partitions(spark, name, part, {v: f"{folder}/{partition_name(part, v)}" for v in {*written, *values}})
    spark.catalog.refreshTable(name)
    _note_size(spark, name)


def _note_size(spark: SparkSession, name: str) -> None:
    """Record the table's bytes (from file listings, no scan) for broadcast decisions and scan estimates."""

    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def save_partitioned(
    df: DataFrame,
    name: str,
    field: str,
    kind: str = "DAY",
    disposition: str = WRITE_TRUNCATE,
    *,
    require_filter: bool = False,
    cluster_by: Sequence[str] = (),
    description: str | None = None,
) -> None:
    """A table partitioned by the hour, day, month or year of ``field``."""

    layout = Layout(
        partition_field=field, partition_kind=kind, require_filter=require_filter, cluster_by=tuple(cluster_by)
    )
    save_table(df, name, disposition, layout=layout, description=description)


def save_grouped(
    df: DataFrame, name: str, keys: str | Sequence[str], groups: int, disposition: str = WRITE_TRUNCATE, *, cluster_by: Sequence[str] = ()
) -> None:
    """A table in ``groups`` groups by a hash of its merge keys: a merge reads and rewrites those its keys fall in only.

    One key's rows share a group; a group that grows large is spread over several files.
    """

    save_table(df, name, disposition, layout=Layout(group_by=tuple(as_list(keys)), groups=groups, cluster_by=tuple(cluster_by)))


def replace_partitions(df: DataFrame, name: str) -> None:
    """Replace exactly the partitions that ``df`` has rows for, in a partitioned table."""

    rewrite_partitions(df, name)


def drop_partition(spark: SparkSession, name: str, value) -> None:
    """Empty the partition that ``value`` of the partition field falls in; one that is not there is fine."""

    layout = Layout.of(table_properties(spark, name))
    kind = spark.table(name).schema[layout.partition_field].dataType
    shown = spark.range(1).select(partition_value(F.lit(value).cast(kind), layout.partition_kind).cast("string")).first()[0]
    known = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    if partition_name(layout.part, shown) in known:
        rewrite_partitions(whole_table(spark, name).limit(0), name, [shown])


def save_clustered(df: DataFrame, name: str, fields: str | Sequence[str], disposition: str = WRITE_TRUNCATE) -> None:
    save_table(df, name, disposition, layout=Layout(cluster_by=tuple(as_list(fields))))


def save_bucketed(
    df: DataFrame, name: str, keys: str | Sequence[str], buckets: int, disposition: str = WRITE_TRUNCATE
) -> None:
    """A table hashed by its merge keys into ``buckets``: upserts and deletes by those keys skip its shuffle.

    A large table has a multiple of ``buckets``, one for each ``BUCKET_BYTES`` that its rows scan. One key's rows
    share a bucket, so this is for keys that do not repeat much.
    """

    save_table(df, name, disposition, layout=Layout(bucket_by=tuple(as_list(keys)), buckets=buckets))


def copy_tables(
    spark: SparkSession, sources: str | Sequence[str], target: str, disposition: str = WRITE_TRUNCATE
) -> None:
    """Copy one table, or the union of several with the same columns."""

    names = as_list(sources)
    layout = Layout.of(table_properties(spark, names[0])) if len(names) == 1 else None
    save_table(union_all(whole_table(spark, s) for s in names), target, disposition, layout=layout)


def whole_table(spark: SparkSession, name: str) -> DataFrame:
    """All rows of a table, also of one that otherwise has to be read by partition."""

    if not table_exists(spark, name):
        raise TableMissing(name)
    return without_partition_column(spark.table(name), table_properties(spark, name))


def snapshot_table(spark: SparkSession, source: str, target: str, expires_at: dt.datetime | None = None) -> None:
    """The rows of a table as they are, under a name that must not hold rows yet; once expired it reads as missing.

    Without an expiry it stays. No file is written: the snapshot is an entry for the same folders, which the source
    leaves when it is rewritten and ``retention.drop_old_files`` keeps as long as the entry is there. A table of
    another writer may be changed in place, so it is copied.
    """

    if not table_exists(spark, source):
        raise TableMissing(source)
    properties = table_properties(spark, source)
    if OLD_FOLDERS in properties:
        if table_exists(spark, target) and not spark.table(target).isEmpty():
            raise TableNotEmpty(target)
        _share(spark, source, target, properties)
    else:
        copy_tables(spark, source, target, WRITE_EMPTY)
    if expires_at is not None:
        if expires_at.tzinfo is None:
            expires_at = expires_at.replace(tzinfo=dt.timezone.utc)
        set_properties(spark, target, {EXPIRES_AT: expires_at.isoformat()})
    _note_size(spark, target)


def _share(spark: SparkSession, source: str, target: str, properties: dict[str, str]) -> None:
    # Noted first: a folder is spared before anything else names it.
    owners = [source, *(n for n in lines(properties.get(SNAPSHOT_OF)) if spark.catalog.tableExists(n))]
    for owner in owners:
        noted = dict.fromkeys([*lines(table_properties(spark, owner).get(SNAPSHOTS)), target])
        set_properties(spark, owner, {SNAPSHOTS: "\n".join(noted)})
    set_properties(spark, source, {SHARED: "true"})
    part, folder = Layout.of(properties).part, location(spark, source)
    spark.sql(f"DROP TABLE IF EXISTS {target}")
    spark.sql(f"CREATE TABLE {short(target)} LIKE {short(source)} LOCATION {sql_text(folder)}")
    kept = {k: v for k, v in properties.items() if k in LAYOUT_PROPERTIES or k.startswith(LABEL)}
    set_properties(spark, target, {**kept, SHARED: "true", SNAPSHOT_OF: "\n".join(owners), OLD_FOLDERS: ""})
    if part:
        named = {}
        for held in file_folders(spark.table(source)):
            value = held.rsplit("/", 1)[1].split("=", 1)[1]
            named[None if value == NULL_PARTITION else value] = held
        point_partitions(spark, target, part, named)


def drop_snapshot(spark: SparkSession, name: str) -> None:
    """Drop a snapshot's entry; one that is gone is fine. A table no snapshot is left of may be added to in place again."""

    if not spark.catalog.tableExists(name):
        return
    owners = lines(table_properties(spark, name).get(SNAPSHOT_OF))
    spark.sql(f"DROP TABLE {name}")
    for owner in filter(spark.catalog.tableExists, owners):
        properties = table_properties(spark, owner)
        left = [n for n in lines(properties.get(SNAPSHOTS)) if n != name and spark.catalog.tableExists(n)]
        set_properties(spark, owner, {SNAPSHOTS: "\n".join(left)})
        if not left and not lines(properties.get(SNAPSHOT_OF)):
            unset_properties(spark, owner, SHARED)


def create_view(spark: SparkSession, name: str, query: str, replace: bool = True) -> None:
    """A view; with ``replace=False`` an existing one is an error."""

    spark.sql(f"CREATE {'OR REPLACE ' if replace else ''}VIEW {name} AS {query}")


def table_from_query(
    spark: SparkSession,
    sql: str,
    name: str,
    *,
    args: dict | None = None,
    schema: T.StructType | None = None,
    cluster_by: Sequence[str] | None = None,
    labels: dict[str, str] | None = None,
    bytes_budget: int | None = None,
) -> None:
    """Store a query's result. With a schema the table is made anew with it and a mismatch is an error."""

    from relops.plans.guard import DEFAULT_BUDGET, guarded_query

    result = guarded_query(spark, sql, args, DEFAULT_BUDGET if bytes_budget is None else bytes_budget)
    if schema is not None:
        result = conform(result, schema)
    save_table(result, name, WRITE_TRUNCATE, layout=Layout(cluster_by=tuple(cluster_by or ())), labels=labels)


# Beginnings of Spark's names for errors that lie in the data; all others end the load with the error.
DATA_ERRORS = re.compile(
    r"\[(?:MALFORMED_|CAST_|INVALID_|CANNOT_PARSE_|NUMERIC_|ARITHMETIC_OVERFLOW|DATETIME_|FAILED_READ_FILE|NOT_NULL_|USER_RAISED_EXCEPTION|DIVIDE_BY_ZERO|VALUE_)"
)


def _accepted(name: str, save: Callable[[], None]) -> bool:
    """Whether a load went through; one that its rows forbid is logged instead.

    That is bad values, columns that do not fit the table, and a table that is not empty. A lost executor, a full disk
    or a wrong call is no verdict on the rows and is raised.
    """

    try:
        save()
        return True
    except (TableNotEmpty, ColumnMismatch, AnalysisException) as error:
        log.error("load of %s refused: %s", name, error)
    except (PySparkException, Py4JJavaError) as error:
        if not DATA_ERRORS.search(str(error)):
            raise
        log.error("load of %s failed: %s", name, error)
    return False


def load_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    name: str,
    schema: T.StructType,
    file_format: str,
    disposition: str = WRITE_EMPTY,
    *,
    layout: Layout | None = None,
    description: str | None = None,
    ignore_unknown: bool = False,
    **csv_options,
) -> bool:
    """CSV or JSON-lines files (``csv`` or ``jsonl``) into a table; False when the load is rejected."""

    def save() -> None:
        if file_format == "csv":
            rows = scan_csv(spark, paths, _nullable(schema), **csv_options)
        elif file_format == "jsonl":
            rows = scan_jsonl(spark, paths, _nullable(schema), ignore_unknown=ignore_unknown)
        else:
            raise ValueError(f"unknown file format {file_format}")
        save_table(conform(rows, schema), name, disposition, layout=layout, description=description)

    return _accepted(name, save)


def load_records(
    spark: SparkSession,
    records: Iterable[dict],
    name: str,
    schema: T.StructType | None = None,
    disposition: str = WRITE_TRUNCATE,
    *,
    layout: Layout | None = None,
    description: str | None = None,
    ignore_unknown: bool = False,
) -> bool:
    """Driver-side records into a table; False when the load is rejected."""

    def save() -> None:
        rows = records_to_df(spark, records, schema, ignore_unknown=ignore_unknown)
        save_table(rows, name, disposition, layout=layout, description=description)

    return _accepted(name, save)


@dataclasses.dataclass(kw_only=True)
class TableSpec:
    """Records for one table of a bulk load."""

    schema_name: str
    table_name: str
    records: list[dict]
    schema: T.StructType
    is_sharded: bool = False


def load_tables(spark: SparkSession, tables: Sequence[TableSpec], snapshot_date: dt.date) -> list[str]:
    """Load many record sets; sharded tables get the date suffix. Returns the table ids."""

    names = []
    for spec in tables:
        if spec.schema is None:
            raise ValueError(f"no schema for {spec.table_name}")
        suffix = f"{snapshot_date:%Y%m%d}" if spec.is_sharded else ""
        name = f"{spec.schema_name}.{spec.table_name}{suffix}"
        save_table(records_to_df(spark, spec.records, spec.schema), name, WRITE_EMPTY)
        names.append(name)
    return names
