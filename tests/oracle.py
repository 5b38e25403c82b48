"""Runs a registered query and its SQL side by side and compares names, types and values."""

from __future__ import annotations

import decimal
import math

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, decimal.Decimal):
        return value.normalize()
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def _kind(dtype: pa.DataType) -> str:
    if pa.types.is_timestamp(dtype):
        return "timestamp"
    if pa.types.is_large_string(dtype) or pa.types.is_string(dtype) or dtype == pa.string_view():
        return "string"
    if pa.types.is_null(dtype):
        return "null"
    return str(dtype).replace("large_", "")


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def differences(spark_table: pa.Table, oracle_table: pa.Table) -> list[str]:
    found = []
    left, right = sorted(spark_table.column_names), sorted(oracle_table.column_names)
    if left != right:
        return [f"columns {left} against {right}"]
    for name in left:
        one, two = _kind(spark_table.schema.field(name).type), _kind(oracle_table.schema.field(name).type)
        if one != two:
            found.append(f"type of {name}: {one} against {two}")
    if spark_table.num_rows != oracle_table.num_rows:
        found.append(f"{spark_table.num_rows} rows against {oracle_table.num_rows}")
    one, two = rows_of(spark_table), rows_of(oracle_table)
    if one != two:
        only_one = [r for r in one if r not in set(two)][:3] if len(one) < 200000 else []
        only_two = [r for r in two if r not in set(one)][:3] if len(two) < 200000 else []
        found.append(f"values differ, spark only {only_one}, oracle only {only_two}")
    return found
