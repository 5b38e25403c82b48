"""Reshaping of records: key cleaning, semi-structured access, list chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import col
from relops.functions.dates import (
    DATE_FORMATS,
    TIMESTAMP_FORMATS,
    parse_date_text,
    parse_timestamp_text,
    partition_stamp,
)

# What may not start a field name, and what becomes an underscore inside one.
LEADING_JUNK = "^[^A-Za-z0-9]+"
NON_WORD = r"\W+"


def clean_key(name: str) -> str:
    return re.sub(NON_WORD, "_", re.sub(LEADING_JUNK, "", name))


def clean_key_column(name: Column) -> Column:
    """The same rule for map keys, which are data; ``(?U)`` makes the JVM's word class Unicode-aware."""

    return F.regexp_replace(F.regexp_replace(name, LEADING_JUNK, ""), f"(?U){NON_WORD}", "_")


def _last_by_name(fields: Sequence[T.StructField], convert: Callable[[str], str]) -> dict[str, T.StructField]:
    """Converted name to field; of colliding fields the last one counts."""

    return {convert(f.name): f for f in fields}


def _rename(value: Column, dtype: T.DataType, convert, convert_column) -> Column:
    if isinstance(dtype, T.StructType):
        fields = [
            _rename(value.getField(f.name), f.dataType, convert, convert_column).alias(name)
            for name, f in _last_by_name(dtype.fields, convert).items()
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType) and _has_names(dtype.elementType):
        return F.transform(value, lambda x: _rename(x, dtype.elementType, convert, convert_column))
    if isinstance(dtype, T.MapType):
        keys = F.transform(F.map_keys(value), convert_column)
        values = F.transform(F.map_values(value), lambda x: _rename(x, dtype.valueType, convert, convert_column))
        last = F.filter(
            F.arrays_zip(keys.alias("k"), values.alias("v")),
            lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"]),
        )
        return F.map_from_entries(last)
    return value


def _has_names(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_names(dtype.elementType)
    return isinstance(dtype, (T.StructType, T.MapType))


def clean_keys(
    df: DataFrame,
    convert: Callable[[str], str] = clean_key,
    convert_column: Callable[[Column], Column] = clean_key_column,
) -> DataFrame:
    """Rename every column, nested field and map key; values stay. Of names that collide the last one wins."""

    return df.select(
        *[
            _rename(col(f.name), f.dataType, convert, convert_column).alias(name)
            for name, f in _last_by_name(df.schema.fields, convert).items()
        ]
    )


def add_partition_date(df: DataFrame, date, kind: str = "DAY", field: str = "snapshot_date") -> DataFrame:
    """Every row stamped with the partition date as text."""

    return df.withColumn(field, partition_stamp(date, kind))


def parse_typed_fields(
    df: DataFrame,
    date_fields: Sequence[str] = (),
    timestamp_fields: Sequence[str] = (),
    date_formats: Sequence[str] = DATE_FORMATS,
    timestamp_formats: Sequence[str] = TIMESTAMP_FORMATS,
) -> DataFrame:
    """Named string fields, at any depth, as dates or timestamps.

    A column has one type, so text no format can read moves to ``<field>_raw`` and the typed field is null.
    """

    def typed(name: str, value: Column, dtype: T.DataType) -> list[Column]:
        if isinstance(dtype, T.StringType) and (name in date_fields or name in timestamp_fields):
            parsed = (
                parse_date_text(value, date_formats)
                if name in date_fields
                else parse_timestamp_text(value, timestamp_formats)
            )
            return [parsed.alias(name), F.when(parsed.isNull(), value).alias(f"{name}_raw")]
        return [walk(value, dtype).alias(name)]

    def walk(value: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            fields = [c for f in dtype.fields for c in typed(f.name, value.getField(f.name), f.dataType)]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(dtype, T.ArrayType) and _has_names(dtype.elementType):
            return F.transform(value, lambda x: walk(x, dtype.elementType))
        return value

    return df.select(*[c for f in df.schema.fields for c in typed(f.name, col(f.name), f.dataType)])


def _path(*keys: str) -> str:
    return "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)


def get_or_none(record: Column, *keys: str, dtype: str = "string") -> Column:
    """Entry of a VARIANT record as ``dtype``; null when absent, an error when it cannot be cast."""

    return F.variant_get(record, _path(*keys), dtype)


def ensure_list(record: Column, *keys: str) -> Column:
    """Entry of a VARIANT record as an array: absent gives an empty one, a single value is wrapped."""

    entry = F.variant_get(record, _path(*keys), "variant")
    shape = F.schema_of_variant(entry)
    return (
        F.when(shape.isNull(), F.array().cast("array<variant>"))
        .when(shape.startswith("ARRAY"), F.variant_get(record, _path(*keys), "array<variant>"))
        .otherwise(F.array(entry))
    )


def ensure_list_or_none(record: Column, key: str, sub_key: str) -> Column:
    """As :func:`ensure_list` on ``key.sub_key``; null when ``key`` is absent or its ``@count`` is the text "0"."""

    outer = F.variant_get(record, _path(key), "variant")
    count = F.variant_get(record, _path(key, "@count"), "variant")
    no_count = F.raise_error(F.lit(f"{key} has no @count")).cast("array<variant>")
    return (
        F.when(outer.isNull() | (F.to_json(count) == '"0"'), F.lit(None).cast("array<variant>"))
        .when(count.isNull(), no_count)
        .otherwise(ensure_list(record, key, sub_key))
    )


def chunk_list(values: Column, size: int = 8) -> Column:
    """Array of consecutive slices of ``size`` elements, the last one possibly shorter."""

    if size < 1:
        raise ValueError("chunk size must be at least 1")

    def chunks(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(size)))
        return F.coalesce(F.transform(starts, lambda i: F.slice(v, i, F.lit(size))), F.slice(F.array(v), 1, 0))

    # Bound as a lambda argument, the array is computed once and not again for every chunk.
    return F.when(values.isNotNull(), F.transform(F.array(values), chunks)[0])


def attachment_ids(parts: Column) -> Column:
    """Attachment ids of the message parts that carry a file name; no parts give an empty array."""

    named = F.filter(parts, lambda p: p["filename"] != "")
    return F.coalesce(F.transform(named, lambda p: p["body"]["attachmentId"]), F.array().cast("array<string>"))


def sort_lists(df: DataFrame) -> DataFrame:
    """Every array, at any depth, in a canonical order, for comparisons that ignore list order."""

    def walk(value: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            fields = [walk(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(dtype, T.ArrayType):
            return F.array_sort(F.transform(value, lambda x: walk(x, dtype.elementType)))
        if isinstance(dtype, T.MapType):
            return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"], walk(e["value"], dtype.valueType).alias("value"))))
        return value

    return df.select(*[walk(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def field_paths(dtype: T.DataType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of every field, parents before children, in schema order."""

    if isinstance(dtype, T.ArrayType):
        return field_paths(dtype.elementType, prefix)
    if not isinstance(dtype, T.StructType):
        return []
    return [
        row
        for f in dtype.fields
        for row in [
            (f"{prefix}{f.name}", f.dataType.simpleString()),
            *field_paths(f.dataType, f"{prefix}{f.name}."),
        ]
    ]


