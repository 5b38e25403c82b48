"""Change-file merging, upsert and delete by key."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relops.columns import (
    ColumnMismatch,
    all_of,
    as_list,
    col,
    quote,
    require_columns,
    require_same_columns,
    split_null_keys,
    splittable_match,
    union_all,
)


def merge_changefiles(changes: DataFrame, key: str | Sequence[str], seq: str) -> DataFrame:
    """Keep, per key, all rows of the last change file that has the key; ``seq`` numbers the files.

    The last file per key is found by a combining aggregation and joined back on (key, seq), so a key that
    fills a third of the rows is spread over its files instead of landing in one window task. A null key is a
    key like any other.
    """

    keys = as_list(key)
    require_columns(changes, [*keys, seq], "change files")
    last = changes.groupBy(*map(quote, keys)).agg(F.max(col(seq)).alias("__relops_last"))
    last = last.select(*_renamed(keys), "__relops_last")
    same_key = all_of(col(k).eqNullSafe(F.col(f"__relops_k{i}")) for i, k in enumerate(keys))
    return changes.join(last, same_key & (col(seq) == F.col("__relops_last")), "left_semi")


def _equal(pairs: Iterable[tuple[Column, Column]]) -> Column:
    return all_of(left == right for left, right in pairs)


def _renamed(keys: Sequence[str]) -> list[Column]:
    return [col(k).alias(f"__relops_k{i}") for i, k in enumerate(keys)]


def upsert(
    main: DataFrame, updates: DataFrame, keys: str | Sequence[str], *, co_located: bool = False
) -> DataFrame:
    """MERGE semantics: matched rows take every top-level column of their update, other updates are inserted.

    Null keys never match. One update may hit many main rows; two updates for one main row fail the job.
    See :func:`apply_changes` for how it is run.
    """

    return apply_changes(main, updates, None, keys, co_located=co_located)


def apply_changes(
    main: DataFrame,
    updates: DataFrame,
    deletes: DataFrame | None,
    keys: str | Sequence[str],
    delete_keys: str | Sequence[str] | None = None,
    *,
    co_located: bool = False,
) -> DataFrame:
    """An upsert followed by a delete of the same keys, in one join over the main table.

    The main table is the left side of a left join against one row per changed key: a small change set is broadcast
    and main is not shuffled, beyond Spark's broadcast threshold AQE can split a hot main key. A full outer join
    allows neither. Inserts are found from main's key columns alone. ``co_located`` says that main is bucketed by
    the keys: it is then joined where it lies, without a shuffle and without splitting.

    ``updates`` is read several times: stage it first when it is a long computation.
    """

    keys = as_list(keys)
    require_same_columns(main, updates, "upsert")
    require_columns(main, keys, "main table")
    names = [quote(k) for k in keys]
    copies = [F.col(f"__relops_k{i}") for i in range(len(keys))]
    matches = _equal if co_located else splittable_match

    main_keyed, main_null = split_null_keys(main, keys)
    upd_keyed, upd_null = split_null_keys(updates, keys)

    changed = upd_keyed.select(*_renamed(keys), F.struct(*map(col, updates.columns)).alias("__relops_row"))
    gone = None
    if deletes is not None:
        delete_keys = keys if delete_keys is None else as_list(delete_keys)
        _check_delete_keys(main, deletes, keys, delete_keys)
        gone, _ = split_null_keys(deletes, delete_keys)
        gone = gone.select(*_renamed(delete_keys)).distinct()
        changed = changed.unionByName(gone.withColumn("__relops_gone", F.lit(True)), allowMissingColumns=True)
    else:
        changed = changed.withColumn("__relops_gone", F.lit(None).cast("boolean"))
    per_key = changed.groupBy(*copies).agg(
        F.count("__relops_row").alias("__relops_n"),
        F.first("__relops_row", ignorenulls=True).alias("__relops_new"),
        F.coalesce(F.max("__relops_gone"), F.lit(False)).alias("__relops_gone"),
    )
    ambiguous = F.raise_error(F.lit(f"upsert: several updates for one row of the main table, keys {keys}"))
    kept = F.when(F.col("__relops_n") > 1, ambiguous.cast("boolean")).otherwise(~F.coalesce("__relops_gone", F.lit(False)))
    merged = (
        main_keyed.join(per_key, matches(zip(map(col, keys), copies)), "left")
        .filter(kept)
        .select(*[F.when(F.col("__relops_n") > 0, F.col(f"__relops_new.{quote(c)}")).otherwise(col(c)).alias(c) for c in main.columns])
    )

    wanted = upd_keyed.select(*_renamed(keys)).distinct()
    present = main_keyed.select(*names).join(wanted, matches(zip(map(col, keys), copies)), "left_semi")
    taken = present.select(*_renamed(keys))
    taken = (taken if gone is None else taken.unionByName(gone)).distinct()
    inserts = upd_keyed.join(taken, matches(zip(map(col, keys), copies)), "left_anti")
    return union_all([merged, main_null, inserts, upd_null])


def _check_delete_keys(main: DataFrame, deletes: DataFrame, main_keys: list[str], delete_keys: list[str]) -> None:
    require_columns(main, main_keys, "main table")
    require_columns(deletes, delete_keys, "delete table")
    if len(main_keys) != len(delete_keys):
        raise ColumnMismatch(f"{len(main_keys)} main keys against {len(delete_keys)} delete keys")
    for m, d in zip(main_keys, delete_keys):
        if main.schema[m].dataType != deletes.schema[d].dataType:
            raise ColumnMismatch(
                f"type of {m} is {main.schema[m].dataType.simpleString()}, "
                f"of {d} {deletes.schema[d].dataType.simpleString()}"
            )


def delete_by_keys(
    main: DataFrame,
    deletes: DataFrame,
    main_keys: str | Sequence[str],
    delete_keys: str | Sequence[str] | None = None,
    *,
    main_prefix: str = "",
    delete_prefix: str = "",
    co_located: bool = False,
) -> DataFrame:
    """Main rows without a partner in ``deletes``; every key pair must match, prefixes added to each side first.

    A left anti join against the distinct delete keys, so repeated deletes cost nothing and AQE can split a hot
    main key. Null keys match nothing and stay. ``co_located`` is as for :func:`upsert`.
    """

    matched = _by_keys(main, deletes, main_keys, delete_keys, main_prefix, delete_prefix, co_located, "left_anti")
    return union_all([matched, split_null_keys(main, as_list(main_keys))[1]])


def matched_by_keys(
    main: DataFrame,
    changes: DataFrame,
    main_keys: str | Sequence[str],
    change_keys: str | Sequence[str] | None = None,
    *,
    main_prefix: str = "",
    change_prefix: str = "",
) -> DataFrame:
    """Main rows with a partner in ``changes``: those that :func:`delete_by_keys` leaves out."""

    return _by_keys(main, changes, main_keys, change_keys, main_prefix, change_prefix, False, "left_semi")


def _by_keys(
    main: DataFrame,
    deletes: DataFrame,
    main_keys: str | Sequence[str],
    delete_keys: str | Sequence[str] | None,
    main_prefix: str,
    delete_prefix: str,
    co_located: bool,
    how: str,
) -> DataFrame:
    main_keys = as_list(main_keys)
    delete_keys = main_keys if delete_keys is None else as_list(delete_keys)
    _check_delete_keys(main, deletes, main_keys, delete_keys)
    prefixed = bool(main_prefix or delete_prefix)

    def key(name: str, prefix: str):
        return F.concat(F.lit(prefix), col(name).cast("string")) if prefixed else col(name)

    main_keyed, _ = split_null_keys(main, main_keys)
    del_keyed, _ = split_null_keys(deletes, delete_keys)
    targets = del_keyed.select(
        *[key(d, delete_prefix).alias(f"__relops_k{i}") for i, d in enumerate(delete_keys)]
    ).distinct()
    matches = _equal if co_located else splittable_match
    match = matches((key(m, main_prefix), F.col(f"__relops_k{i}")) for i, m in enumerate(main_keys))
    return main_keyed.join(targets, match, how)
