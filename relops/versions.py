"""Version folders of catalog tables: new files go to a fresh folder, then the catalog is pointed at them.

Every folder a table's files were ever written to is noted with the table, so that those nothing points at any more
can be deleted. A snapshot is a second catalog entry for the same folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.columns import quote

# The folders of a table's files so far, one a line; tables of other writers do not have it.
OLD_FOLDERS = "relops.old_folders"
# A complete new version that waits to take this table's name.
REPLACES = "relops.replaces"
# The folders are also those of a snapshot or its source, so no file may be added to them.
SHARED = "relops.shared"
# The snapshots that were taken of a table, one a line.
SNAPSHOTS = "relops.snapshots"
# The tables whose folders a snapshot may read: what it was taken of, and what that was taken of.
SNAPSHOT_OF = "relops.snapshot_of"
# How Spark names the partition of null.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def set_properties(spark: SparkSession, name: str, properties: dict[str, str]) -> None:
    if properties:
        pairs = ", ".join(f"{sql_text(k)} = {sql_text(v)}" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")


def unset_properties(spark: SparkSession, name: str, *keys: str) -> None:
    spark.sql(f"ALTER TABLE {name} UNSET TBLPROPERTIES IF EXISTS ({', '.join(map(sql_text, keys))})")


def table_facts(spark: SparkSession, name: str) -> dict[str, str]:
    """What the catalog says of a table besides its columns: Location, Comment, Type and so on."""

    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    begin = next((i for i, r in enumerate(rows) if r["col_name"] == "# Detailed Table Information"), -1)
    return {r["col_name"]: r["data_type"] for r in rows[begin + 1 :]}


def location(spark: SparkSession, name: str) -> str:
    return table_facts(spark, name)["Location"].rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table's files, below its schema's location.

    Not below the table's default folder: dropping a table that plain Spark made there would take it along.
    """

    *schema, table = name.split(".")
    home = spark.catalog.getDatabase(".".join(schema) or spark.catalog.currentDatabase()).locationUri
    return f"{home.rstrip('/')}/{table}__versions/{uuid.uuid4().hex}"


def lines(value: str | None) -> list[str]:
    return [x for x in (value or "").split("\n") if x]


def note_folders(spark: SparkSession, name: str, *folders: str) -> None:
    known = lines(table_properties(spark, name).get(OLD_FOLDERS))
    set_properties(spark, name, {OLD_FOLDERS: "\n".join(dict.fromkeys([*known, *folders]))})


def short(name: str) -> str:
    return ".".join(name.split(".")[-2:])


def swap_in(spark: SparkSession, fresh: str, name: str) -> None:
    """Give ``name`` the files of the table ``fresh``, which then is no more.

    A table of the same columns is pointed at the new folder, in one step. Any other is dropped and ``fresh`` takes
    its name; should the driver be lost in between, the next access finishes that (:func:`finish_swap`).
    """

    folder = location(spark, fresh)
    if spark.catalog.tableExists(name) and _same_entry(spark, fresh, name):
        note_folders(spark, name, location(spark, name), folder)
        spark.sql(f"ALTER TABLE {name} SET LOCATION {sql_text(folder)}")
        unset_properties(spark, name, SHARED)
        spark.sql(f"DROP TABLE {fresh}")
        return
    set_properties(spark, fresh, {REPLACES: short(name)})
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {short(name)}")
    unset_properties(spark, name, REPLACES)


def _same_entry(spark: SparkSession, fresh: str, name: str) -> bool:
    """Whether a change of the location alone makes the one table the other."""

    one, two = (table_facts(spark, n) for n in (fresh, name))
    own = OLD_FOLDERS in table_properties(spark, name)
    alike = all(one.get(k) == two.get(k) for k in ("Provider", "Num Buckets", "Bucket Columns", "Sort Columns"))
    whole = "# Partition Information" not in {r["col_name"] for r in spark.sql(f"DESCRIBE TABLE {name}").collect()}
    return own and alike and whole and spark.table(fresh).schema == spark.table(name).schema


def finish_swap(spark: SparkSession, name: str) -> bool:
    """Whether a missing table had a complete new version waiting, which now bears its name."""

    *schema, table = short(name).split(".")
    home = f" IN {schema[0]}" if schema else ""
    if schema and not spark.catalog.databaseExists(".".join(name.split(".")[:-1])):
        return False
    for row in spark.sql(f"SHOW TABLES{home} LIKE {sql_text(table + '__*')}").collect():
        waiting = ".".join([*schema, row["tableName"]])
        if not row["isTemporary"] and table_properties(spark, waiting).get(REPLACES) == short(name):
            spark.sql(f"ALTER TABLE {waiting} RENAME TO {short(name)}")
            unset_properties(spark, name, REPLACES)
            return True
    return False


def folder_of(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def partition_name(part: str, value: str | None) -> str:
    """The folder of one partition; the values used here need no escaping."""

    return f"{part}={NULL_PARTITION if value is None else value}"


def point_partitions(spark: SparkSession, name: str, part: str, folders: dict[str | None, str]) -> None:
    """Point partitions of a table, by value, at folders; those the table lacks are added in one step.

    Each is one step of the catalog. Should the driver be lost in between, some partitions are new and none is lost.
    """

    quoted = lambda v: f"({quote(part)} = {'null' if v is None else sql_text(v)})"
    known = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    added = []
    for value, folder in folders.items():
        if partition_name(part, value) in known:
            spark.sql(f"ALTER TABLE {name} PARTITION {quoted(value)} SET LOCATION {sql_text(folder)}")
        else:
            added.append(f"PARTITION {quoted(value)} LOCATION {sql_text(folder)}")
    for begin in range(0, len(added), 500):
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(added[begin : begin + 500])}")


def file_folders(table: DataFrame) -> list[str]:
    """The folders that a table's files lie in, from one distributed pass over file names."""

    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
    found = table.select(folder.alias("folder")).distinct().collect()
    return [spark_path(table.sparkSession, r["folder"]) for r in found]


def spark_path(spark: SparkSession, uri: str) -> str:
    """A path as the catalog spells it, from the escaped form that file metadata has."""

    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString().rstrip("/")


def live_places(spark: SparkSession, name: str) -> set[tuple[str, str | None]]:
    """What a table reads: version folders whole (``""``), or one partition of a version.

    The folder that new partitions of a partitioned table go to stays, whatever lies in it (None).
    """

    folder = spark_path(spark, location(spark, name).replace(" ", "%20"))
    parted = "# Partition Information" in {r["col_name"] for r in spark.sql(f"DESCRIBE TABLE {name}").collect()}
    home = (folder.split("/")[-1], None if parted else "")
    return {home, *map(_tail, file_folders(spark.table(name)))}


def delete_unused(spark: SparkSession, folders: Sequence[str], live: set[tuple[str, str | None]]) -> tuple[int, list[str]]:
    """Delete noted folders that nothing live lies in, and unused partitions of the others.

    Returns how many whole folders went, and which are left.
    """

    gone, left = 0, []
    for folder in folders:
        files, path = folder_of(spark, folder)
        own = {place for version, place in live if version == path.getName()}
        if not own:
            gone += files.delete(path, True)
            continue
        left.append(folder)
        if "" in own or not files.exists(path):
            continue
        for inner in files.listStatus(path):
            if inner.isDirectory() and inner.getPath().getName() not in own:
                files.delete(inner.getPath(), True)
    return gone, left


def _tail(folder: str) -> tuple[str, str]:
    """A version's own name, and the partition's below it, if any."""

    *_, last = folder.rstrip("/").split("/")
    if "=" in last:
        return folder.rstrip("/").split("/")[-2], last
    return last, ""
