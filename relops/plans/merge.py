"""Upserts and deletes applied to stored tables, within a scan budget.

A table that is partitioned by time or grouped by its merge keys is changed by rewriting the partitions or groups that
hold a changed row; all others keep their files. Which those are follows from the changes alone where the groups are
made of the merge keys, else from a semi join of the table's key columns. Any other table is written anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from relops.columns import as_list, col, union_all
from relops.operators.incremental import apply_changes, delete_by_keys, matched_by_keys
from relops.plans.guard import DEFAULT_BUDGET, check_budget
from relops.sinks.tables import Layout, WRITE_TRUNCATE, partition_rows, rewrite_partitions, save_table, whole_table
from relops.sizing import read_bytes
from relops.versions import table_properties


def upsert_table(
    spark: SparkSession, main: str, updates: str, keys: str | Sequence[str], bytes_budget: int = DEFAULT_BUDGET
) -> None:
    """Upsert one stored table into another, which keeps its layout."""

    change_table(spark, main, whole_table(spark, updates), None, keys, bytes_budget=bytes_budget)


def delete_from_table(
    spark: SparkSession,
    main: str,
    deletes: str,
    main_keys: str | Sequence[str],
    delete_keys: str | Sequence[str] | None = None,
    *,
    main_prefix: str = "",
    delete_prefix: str = "",
    bytes_budget: int = DEFAULT_BUDGET,
) -> None:
    """Delete from a stored table the rows another one names; it keeps its layout."""

    change_table(
        spark,
        main,
        None,
        whole_table(spark, deletes),
        main_keys,
        delete_keys,
        main_prefix=main_prefix,
        delete_prefix=delete_prefix,
        bytes_budget=bytes_budget,
    )


def change_table(
    spark: SparkSession,
    name: str,
    updates: DataFrame | None,
    deletes: DataFrame | None,
    keys: str | Sequence[str],
    delete_keys: str | Sequence[str] | None = None,
    *,
    main_prefix: str = "",
    delete_prefix: str = "",
    bytes_budget: int = DEFAULT_BUDGET,
) -> int | None:
    """Upsert ``updates``, then delete what ``deletes`` names (either may be None, not both), in a stored table.

    Prefixes are for deletes alone. Returns the number of partitions or groups rewritten, None for a table without.
    Both sets of changes are read several times: stage what takes long to compute. The budget is for the columns read
    of the changes and of what is rewritten; refused before anything is written.
    """

    properties = table_properties(spark, name)
    layout, keys = Layout.of(properties), as_list(keys)
    delete_keys = keys if delete_keys is None else as_list(delete_keys)
    prefixed = bool(main_prefix or delete_prefix)
    if updates is not None and prefixed:
        raise ValueError("prefixes are for deletes alone")
    values = None
    if layout.part is not None:
        values = _touched(spark, name, layout, updates, deletes, keys, delete_keys, main_prefix, delete_prefix)
    main = whole_table(spark, name) if values is None else partition_rows(spark, name, values)
    check_budget(bytes_budget, sum(read_bytes(df) for df in (main, updates, deletes) if df is not None))
    co_located = layout.bucket_by == tuple(keys) and not prefixed
    if updates is None:
        rows = delete_by_keys(
            main, deletes, keys, delete_keys, main_prefix=main_prefix, delete_prefix=delete_prefix, co_located=co_located
        )
    else:
        rows = apply_changes(main, updates, deletes, keys, delete_keys, co_located=co_located)
    if values is None:
        save_table(rows, name, WRITE_TRUNCATE)
        return None
    if values:
        rewrite_partitions(rows, name, values)
    return len(values)


def _touched(
    spark: SparkSession,
    name: str,
    layout: Layout,
    updates: DataFrame | None,
    deletes: DataFrame | None,
    keys: list[str],
    delete_keys: list[str],
    main_prefix: str,
    delete_prefix: str,
) -> list[str | None]:
    """Partitions or groups that hold a row to change, or get one; as many as the catalog holds at most."""

    table = spark.table(name)
    by_keys = bool(layout.group_by) and set(layout.group_by) <= set(keys) and not (main_prefix or delete_prefix)
    main = table.select(*map(col, dict.fromkeys([*keys, layout.part])))
    found = []
    for changes, change_keys in ((updates, keys), (deletes, delete_keys)):
        if changes is None:
            continue
        if by_keys:
            # Only rows with all keys set match anything; an update without them is inserted.
            found.append(changes.select(layout.part_value(dict(zip(keys, change_keys))).alias("part")))
            continue
        hit = matched_by_keys(main, changes, keys, change_keys, main_prefix=main_prefix, change_prefix=delete_prefix)
        found.append(hit.select(col(layout.part).cast("string").alias("part")))
        if changes is updates:
            found.append(updates.select(layout.part_value().alias("part")))
    return [r["part"] for r in union_all(found).distinct().collect()]
