"""Cases that once lost data or gave a wrong answer."""

import datetime as dt

import pytest

from relops.operators.incremental import upsert
from relops.operators.registry import write_release_documents
from relops.sinks import retention, tables
from relops.session import scratch_path
from relops.sources.files import list_files
from relops.staging import with_row_index


def test_only_noted_folders_are_deleted(spark, schema):
    spark.range(3).write.saveAsTable(f"{schema}.one")
    spark.range(4).write.saveAsTable(f"{schema}.two")
    with pytest.raises(ValueError):
        retention.drop_old_files(spark, f"{schema}.one")
    tables.save_table(spark.range(5), f"{schema}.one", "WRITE_TRUNCATE")
    assert retention.drop_old_files(spark, f"{schema}.one") == 0
    tables.save_table(spark.range(6), f"{schema}.one", "WRITE_TRUNCATE")
    assert retention.drop_old_files(spark, f"{schema}.one") == 1
    assert (spark.table(f"{schema}.one").count(), spark.table(f"{schema}.two").count()) == (6, 4)


def test_emptied_partition(spark, schema):
    name, day = f"{schema}.days", dt.date(2022, 5, 6)
    rows = spark.createDataFrame([(1, day), (2, dt.date(2022, 5, 7))], "id int, day date")
    tables.save_partitioned(rows, name, "day", "DAY")
    tables.drop_partition(spark, name, day)
    tables.drop_partition(spark, name, dt.date(2030, 1, 1))
    assert [r["id"] for r in spark.table(name).collect()] == [2]


def test_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, _row string, _n int")
    indexed = with_row_index(df, ["id"]).orderBy("id").collect()
    assert [(r["_row"], r["_n"], r["row_index"]) for r in indexed] == [("a", 5, 0), ("b", 6, 1)]
    changed = spark.createDataFrame([(2, "c", 7)], df.schema)
    assert sorted(map(tuple, upsert(df, changed, "id").collect())) == [(1, "a", 5), (2, "c", 7)]


def test_keys_below_a_root_that_repeats(spark, tmp_path):
    inner = tmp_path / "lake" / "lake" / "2020lake"
    inner.mkdir(parents=True)
    for folder, name in ((inner, "deep.csv"), (tmp_path / "lake", "top.csv")):
        (folder / name).write_text("x")
    found = list_files(spark, str(tmp_path / "lake"))
    assert sorted(r["key"] for r in found.collect()) == ["lake/2020lake/deep.csv", "top.csv"]


def test_documents_written_twice(spark):
    path = scratch_path(spark, "documents")
    first = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, doc string")
    write_release_documents(first, "doc", path, "id")
    write_release_documents(spark.createDataFrame([("b", "three")], first.schema), "doc", path, "id")
    assert sorted((r["id"], r["value"]) for r in spark.read.text(f"{path}/releases").collect()) == [("a", "one"), ("b", "three")]
