"""Removing what has expired: tables, file prefixes, files of replaced table versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from relops.operators.rollups import expired
from relops.sources.tables import table_exists
from relops.versions import OLD_FOLDERS, SNAPSHOTS, delete_unused, folder_of, lines, live_places, set_properties, table_properties


def drop_tables(spark: SparkSession, names: Sequence[str]) -> None:
    """Drop tables; one that is already gone is fine."""

    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_schemas(spark: SparkSession, names: Sequence[str]) -> None:
    """Drop schemas with all their tables; one that is already gone is fine."""

    for name in names:
        spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")


def drop_expired(spark: SparkSession, inventory: DataFrame, age_hours: float, now, prefix: str) -> list[str]:
    """Drop the tables of an inventory whose age has reached ``age_hours``. Returns their ids."""

    old = expired(inventory.filter("table_type <> 'VIEW'"), age_hours, now, prefix=prefix, name="table_id")
    names = [row["table_id"] for row in old.select("table_id").toLocalIterator()]
    drop_tables(spark, names)
    return names


def drop_expired_schemas(spark: SparkSession, inventory: DataFrame, age_hours: float, now, prefix: str) -> list[str]:
    """Drop the schemas of an inventory, with all their tables, whose age has reached ``age_hours``. Returns their names.

    One without a known age stays, and so does the current one.
    """

    old = expired(inventory.filter("created is not null"), age_hours, now, prefix=prefix, name="name")
    current = spark.catalog.currentDatabase()
    names = [row["name"] for row in old.select("name").toLocalIterator() if row["name"] != current]
    drop_schemas(spark, names)
    return names


def delete_prefix(spark: SparkSession, path: str) -> bool:
    """Delete a folder and everything below it; False when there was none."""

    files, folder = folder_of(spark, path)
    return files.delete(folder, True)


def drop_old_files(spark: SparkSession, table: str) -> int:
    """Delete the files of earlier versions of a table; the number of version folders deleted.

    Only folders that this package wrote and noted; a table of another writer is refused. What the table or one of
    its snapshots still reads stays, an expired snapshot does not count. Only for when no query reads the rest.
    """

    properties = table_properties(spark, table)
    if OLD_FOLDERS not in properties:
        raise ValueError(f"{table} was not written by this package; its folders are not known")
    snapshots = [n for n in lines(properties.get(SNAPSHOTS)) if table_exists(spark, n)]
    live = set().union(*(live_places(spark, n) for n in [table, *snapshots]))
    gone, left = delete_unused(spark, lines(properties[OLD_FOLDERS]), live)
    set_properties(spark, table, {OLD_FOLDERS: "\n".join(left), SNAPSHOTS: "\n".join(snapshots)})
    return gone
