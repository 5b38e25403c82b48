"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ColumnMismatch(ValueError):
    """Tables that must line up do not."""


def as_list(keys: str | Sequence[str]) -> list[str]:
    names = [keys] if isinstance(keys, str) else list(keys)
    if not names:
        raise ValueError("at least one key column is needed")
    return names


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column, whatever characters its name holds."""

    return F.col(quote(name))


def require_columns(df: DataFrame, names: Iterable[str], side: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnMismatch(f"{side} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")


def _strip(dtype: T.DataType) -> T.DataType:
    """The type without nullability and metadata, which do not matter for comparing tables."""

    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _strip(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_strip(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(_strip(dtype.keyType), _strip(dtype.valueType))
    return dtype


def require_same_columns(left: DataFrame, right: DataFrame, what: str) -> None:
    """Names, types and order must agree, nested fields included."""

    if _strip(left.schema) != _strip(right.schema):
        raise ColumnMismatch(
            f"{what}: columns differ or are in another order: "
            f"{left.schema.simpleString()} against {right.schema.simpleString()}"
        )


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def splittable_match(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """Equality of keys that are not null on one side at least, as a join AQE can split.

    AQE splits a hot key only where both join inputs come straight from a shuffle. Written with ``=`` the planner
    would reuse the partitioning of an aggregate on the same keys and leave that side without one; ``<=>`` gives
    the same matches and makes it shuffle the (aggregated, smaller) side once more.
    """

    return all_of(left.eqNullSafe(right) for left, right in pairs)


def split_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose keys are all set, and the others (None when the schema rules them out).

    A null key matches nothing, yet in an outer or anti join all such rows would hash to one task.
    Kept apart they are never shuffled, and where a file has no nulls its statistics skip the second scan.
    """

    nullable = [k for k in keys if df.schema[k].nullable]
    if not nullable:
        return df, None
    missing = any_of(col(k).isNull() for k in nullable)
    return df.filter(all_of(col(k).isNotNull() for k in nullable)), df.filter(missing)


def union_all(parts: Iterable[DataFrame | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])
