"""Differences between tables, key sets and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import all_of, as_list, col, quote, require_columns, split_null_keys, splittable_match, union_all
from relops.functions.nested import sort_lists


def key_set_diff(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Distinct keys with the side that has them: ``left``, ``right`` or ``both``.

    One combining aggregation over both sides; null keys compare equal.
    """

    keys = as_list(keys)
    names = [quote(k) for k in keys]
    marked = left.select(*names, F.lit(1).alias("__relops_l"), F.lit(0).alias("__relops_r")).union(
        right.select(*names, F.lit(0).alias("__relops_l"), F.lit(1).alias("__relops_r"))
    )
    sides = marked.groupBy(*names).agg(F.max("__relops_l").alias("__relops_l"), F.max("__relops_r").alias("__relops_r"))
    side = F.when((F.col("__relops_l") + F.col("__relops_r")) == 2, "both").when(F.col("__relops_l") == 1, "left").otherwise("right")
    return sides.select(*names, side.alias("side"))


def _has(dtype: T.DataType, *kinds: type) -> bool:
    if isinstance(dtype, kinds):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has(f.dataType, *kinds) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has(dtype.elementType, *kinds)
    return isinstance(dtype, T.MapType) and _has(dtype.valueType, *kinds)


def _ordered(value: Column, dtype: T.DataType) -> Column:
    """The value with every map in it as a list of entries in key order, so that equal maps are equal."""

    if not _has(dtype, T.MapType):
        return value
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda one: _ordered(one, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_ordered(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    keys = F.array_sort(F.transform(F.map_keys(value), lambda key, at: F.struct(key.alias("key"), at.alias("at"))))
    values = F.map_values(value)
    return F.transform(
        keys,
        lambda one: F.struct(one["key"].alias("key"), _ordered(F.get(values, one["at"]), dtype.valueType).alias("value")),
    )


def _shown(value: Column, dtype: T.DataType) -> Column:
    nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
    return F.to_json(value) if nested else value.cast("string")


def table_diff(
    expected: DataFrame, actual: DataFrame, keys: str | Sequence[str], *, ignore_list_order: bool = False
) -> DataFrame:
    """Rows (keys, change, field, expected, actual), one per difference; empty when the tables agree.

    ``change`` is ``only_expected``, ``only_actual``, ``duplicate_key`` (counts of both sides), ``value``,
    ``field_only_expected`` or ``field_only_actual``. A key met several times on a side has no one row to compare,
    so it is reported instead. The order of a map's entries never counts.

    Both sides meet in one combining aggregation per key rather than a join, so repeated keys cannot multiply.
    """

    keys = as_list(keys)
    require_columns(expected, keys, "expected table")
    require_columns(actual, keys, "actual table")
    if ignore_list_order:
        expected, actual = sort_lists(expected), sort_lists(actual)
    names = [quote(k) for k in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*names, F.struct(*map(col, df.columns)).alias(name))

    both = side(expected, "__relops_e").unionByName(side(actual, "__relops_a"), allowMissingColumns=True)
    per_key = both.groupBy(*names).agg(
        F.count("__relops_e").alias("__relops_n_e"),
        F.count("__relops_a").alias("__relops_n_a"),
        F.first("__relops_e", ignorenulls=True).alias("__relops_e"),
        F.first("__relops_a", ignorenulls=True).alias("__relops_a"),
    )

    def entry(when: Column, change: str, field: str | None = None, exp: Column | None = None, act: Column | None = None):
        null = F.lit(None).cast("string")
        made = F.struct(
            F.lit(change).alias("change"),
            F.lit(field).cast("string").alias("field"),
            (null if exp is None else exp).alias("expected"),
            (null if act is None else act).alias("actual"),
        )
        return F.when(when, made)

    n_e, n_a = F.col("__relops_n_e"), F.col("__relops_n_a")
    single = (n_e == 1) & (n_a == 1)
    entries = [
        entry(n_a == 0, "only_expected"),
        entry(n_e == 0, "only_actual"),
        entry((n_e > 1) | (n_a > 1), "duplicate_key", None, n_e.cast("string"), n_a.cast("string")),
    ]
    for name in dict.fromkeys([*expected.columns, *actual.columns]):
        if name in keys:
            continue
        e_type = expected.schema[name].dataType if name in expected.columns else None
        a_type = actual.schema[name].dataType if name in actual.columns else None
        exp = _shown(F.col(f"__relops_e.{quote(name)}"), e_type) if e_type else None
        act = _shown(F.col(f"__relops_a.{quote(name)}"), a_type) if a_type else None
        if exp is None:
            entries.append(entry(single, "field_only_actual", name, None, act))
        elif act is None:
            entries.append(entry(single, "field_only_expected", name, exp, None))
        else:
            one, two = _ordered(F.col(f"__relops_e.{quote(name)}"), e_type), _ordered(F.col(f"__relops_a.{quote(name)}"), a_type)
            if e_type != a_type or _has(e_type, T.VariantType):
                one, two = _shown(one, e_type), _shown(two, a_type)
            entries.append(entry(single & ~one.eqNullSafe(two), "value", name, exp, act))
    return per_key.select(*names, F.inline(F.array_compact(F.array(*entries))))


def transfer_diff(
    source: DataFrame, target: DataFrame, key: str = "key", checksum: str = "checksum", algorithm: str | None = None
) -> DataFrame:
    """What a copy has to move: source rows with the target's checksum and a status.

    ``skip``: present and equal. ``changed``: present, other checksum. ``new``: absent, or a source row without a
    key. ``unverified``: present, but ``algorithm`` (a source column) names no digest to compare by.
    """

    keyed, keyless = split_null_keys(source, [key])
    present = target.groupBy(col(key).alias("__relops_key")).agg(F.max(col(checksum)).alias("target_checksum"))
    known = col(algorithm).isNotNull() if algorithm else F.lit(True)
    status = (
        F.when(F.col("__relops_key").isNull(), "new")
        .when(~known, "unverified")
        .when(col(checksum) == F.col("target_checksum"), "skip")
        .otherwise("changed")
    )
    present = present.filter(F.col("__relops_key").isNotNull())
    compared = keyed.join(present, splittable_match([(col(key), F.col("__relops_key"))]), "left")
    compared = compared.withColumn("status", status).drop("__relops_key")
    if keyless is not None:
        blank = F.lit(None).cast(target.schema[checksum].dataType)
        keyless = keyless.withColumn("target_checksum", blank).withColumn("status", F.lit("new"))
    return union_all([compared, keyless])


def verify_transfers(
    manifest: DataFrame, arrived: DataFrame, key: str = "key", checksum: str = "checksum", retried: str = "retried"
) -> DataFrame:
    """After a copy: ``ok``, ``retry`` for a first bad checksum, ``error`` for a second, ``unchecked`` otherwise.

    A manifest row without a key is ``unchecked``.
    """

    keyed, keyless = split_null_keys(manifest, [key])
    found = arrived.filter(col(key).isNotNull()).groupBy(col(key).alias("__relops_key")).agg(F.max(col(checksum)).alias("__relops_found"))
    bad = F.when(col(retried), "error").otherwise("retry")
    verdict = (
        F.when(F.col("__relops_found").isNull() | col(checksum).isNull(), "unchecked")
        .when(F.col("__relops_found") == col(checksum), "ok")
        .otherwise(bad)
    )
    joined = keyed.join(found, splittable_match([(col(key), F.col("__relops_key"))]), "left")
    joined = joined.withColumn("verdict", verdict).drop("__relops_key", "__relops_found")
    return union_all([joined, None if keyless is None else keyless.withColumn("verdict", F.lit("unchecked"))])


def table_integrity(tables: dict[str, DataFrame], expected_rows: dict[str, int] | None = None) -> DataFrame:
    """Row count per table, and whether it is the expected one (null when none is stated)."""

    expected_rows = expected_rows or {}

    def counted(name: str, df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).cast("bigint")
        wanted = F.lit(expected_rows.get(name)).cast("bigint")
        return df.agg(n.alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", (F.col("n_rows") == wanted).alias("as_expected")
        )

    return union_all(counted(n, d) for n, d in tables.items())


def stored_integrity(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """Facts of stored tables against what is expected of them, a row per table of either side.

    ``facts`` has ``table_id``, ``exists``, ``n_rows`` and ``n_bytes``; ``expected`` has ``table_id``, ``exists``,
    ``expected_rows`` and ``expected_bytes``, where null states nothing. Adds ``as_expected``: every stated fact holds;
    a table with rows or bytes stated is expected to exist.
    """

    stated = expected.select(
        F.col("table_id").alias("__relops_id"),
        F.coalesce("exists", F.lit(True)).alias("expected_exists"),
        F.col("expected_rows").cast("bigint").alias("expected_rows"),
        F.col("expected_bytes").cast("bigint").alias("expected_bytes"),
    )
    both = facts.join(stated, F.col("table_id") == F.col("__relops_id"), "full")
    exists = F.coalesce("exists", F.lit(False))
    holds = [exists == F.coalesce("expected_exists", F.lit(True))]
    holds += [F.coalesce(F.col(n) == F.col(w), F.col(w).isNull()) for n, w in (("n_rows", "expected_rows"), ("n_bytes", "expected_bytes"))]
    names = F.coalesce("table_id", "__relops_id").alias("table_id")
    return both.select(names, exists.alias("exists"), "n_rows", "n_bytes", "expected_rows", "expected_bytes", all_of(holds).alias("as_expected"))
