"""Merges that rewrite only what they touch, replacements in one step, snapshots without copies."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relops.operators.incremental import apply_changes, delete_by_keys
from relops.plans import guard
from relops.plans.merge import change_table, delete_from_table, upsert_table
from relops.sinks import retention, tables
from relops.sources.tables import read_table, table_exists
from relops.versions import file_folders, finish_swap, location, swap_in, table_facts, table_properties

DAY = dt.date(2024, 3, 1)
SCHEMA = "k int, v string, day date, wide string"


def rows(spark, keys, v="a"):
    made = [(k, f"{v}{k}", None if k % 11 == 10 else DAY + dt.timedelta(days=k % 5), "w" * 20) for k in keys]
    return spark.createDataFrame(made, SCHEMA)


def files(spark, name):
    return {r[0] for r in spark.table(name).select("_metadata.file_path").distinct().collect()}


def content(df):
    return sorted(map(tuple, df.select("k", "v", "day", "wide").collect()), key=str)


LAYOUTS = [{"group_by": ("k",), "groups": 7}, {"partition_field": "day"}, {"partition_field": "day", "partition_kind": "YEAR", "cluster_by": ("v",)}, {}]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_merges_rewrite_only_what_they_touch(spark, schema, layout):
    main, updates, gone = (f"{schema}.{n}" for n in ("main", "updates", "gone"))
    layout = tables.Layout(**layout)
    before = rows(spark, range(40))
    changed = rows(spark, [3, 8, 100], "b").union(spark.createDataFrame([(None, "n", DAY, "w")], SCHEMA))
    deleted = spark.createDataFrame([(8,), (13,), (None,), (999,)], "id int")
    tables.save_table(before, main, layout=layout)
    tables.save_table(changed, updates)
    tables.save_table(deleted, gone)
    first = files(spark, main)
    upsert_table(spark, main, updates, "k")
    want = apply_changes(before, changed, None, "k")
    assert content(tables.whole_table(spark, main)) == content(want)
    second = files(spark, main)
    delete_from_table(spark, main, gone, "k", "id")
    want = delete_by_keys(want, deleted, "k", "id")
    assert content(tables.whole_table(spark, main)) == content(want)
    third = files(spark, main)
    if layout.part == "relops_group":
        # Four of seven groups hold a key of the updates, at most; the others keep their files by name.
        assert first & second and second & third and second - first
    if layout.partition_kind == "DAY" and layout.partition_field:
        assert {f.split("day_day=")[1][:10] for f in second - first} == {"2024-03-01", "2024-03-04"}
    assert tables.Layout.of(table_properties(spark, main)) == layout
    whole = content(tables.whole_table(spark, main))
    retention.drop_old_files(spark, main)
    assert content(tables.whole_table(spark, main)) == whole and files(spark, main) == third


def test_updates_that_move_between_partitions(spark, schema):
    name = f"{schema}.days"
    tables.save_partitioned(rows(spark, range(10)), name, "day")
    moved = spark.createDataFrame([(0, "m", dt.date(2030, 1, 1), "w"), (1, "m", None, "w"), (10, "m", DAY, "w")], SCHEMA)
    assert change_table(spark, name, moved, None, "k") == 4
    want = apply_changes(rows(spark, range(10)), moved, None, "k")
    assert content(tables.whole_table(spark, name)) == content(want)
    assert [r["k"] for r in read_table(spark, name, start=dt.date(2030, 1, 1)).collect()] == [0]
    assert change_table(spark, name, None, spark.createDataFrame([], "k int"), "k") == 0


def test_merge_reads_wide_columns_once_and_touched_groups_only(spark, schema):
    name = f"{schema}.main"
    tables.save_grouped(rows(spark, range(200)), name, "k", 16)
    part = tables.partition_rows(spark, name, ["3", "5"])
    plan = apply_changes(part, rows(spark, [3], "b"), None, "k")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    # Rows without a key match nothing: they are read on their own, past all files whose statistics show none.
    whole = [line for line in scans if "wide:string" in line and "PushedFilters: [IsNull(k)]" not in line]
    assert len(whole) == 1 and all("relops_group" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_a_budget_refuses_before_anything_is_written(spark, schema):
    name = f"{schema}.main"
    tables.save_grouped(rows(spark, range(20)), name, "k", 4)
    before = files(spark, name)
    with pytest.raises(guard.BudgetExceeded):
        change_table(spark, name, rows(spark, [1], "b"), None, "k", bytes_budget=0)
    with pytest.raises(ValueError):
        change_table(spark, name, rows(spark, [1], "b"), None, "k", main_prefix="x")
    assert files(spark, name) == before


def test_a_replacement_cut_short_leaves_a_readable_table(spark, schema, monkeypatch):
    name = f"{schema}.main"
    tables.save_table(rows(spark, range(5)), name, description="kept; it's mine", labels={"team": "a"})
    first = location(spark, name)
    plain = spark.sql

    def lost(statement, *args, **kwargs):
        if "SET LOCATION" in statement or "RENAME TO" in statement:
            raise RuntimeError("driver lost")
        return plain(statement, *args, **kwargs)

    for changed in (rows(spark, range(6)), rows(spark, range(6)).withColumn("new", F.lit(1))):
        before = spark.table(name).count()
        monkeypatch.setattr(type(spark), "sql", lambda self, statement, *a, **k: lost(statement, *a, **k))
        with pytest.raises(RuntimeError):
            tables.save_table(changed, name, "WRITE_TRUNCATE")
        monkeypatch.undo()
        assert table_exists(spark, name) and read_table(spark, name).count() in (before, 6)
        tables.save_table(changed, name, "WRITE_TRUNCATE")
        assert read_table(spark, name).columns == changed.columns and location(spark, name) != first
        assert table_facts(spark, name)["Comment"] == "kept; it's mine" and table_properties(spark, name)["relops.label.team"] == "a"
    assert not finish_swap(spark, f"{schema}.nothing")


@pytest.mark.parametrize("layout", [*LAYOUTS, {"bucket_by": ("k",), "buckets": 3}])
def test_snapshots_write_no_file_and_stay(spark, schema, layout):
    """Whatever is done to the source or the snapshot later, the other does not change."""

    main, kept, later = (f"{schema}.{n}" for n in ("main", "kept", "later"))
    layout = tables.Layout(**layout)
    tables.save_table(rows(spark, range(30)), main, layout=layout)
    was = content(tables.whole_table(spark, main))
    tables.snapshot_table(spark, main, kept)
    assert files(spark, kept) == files(spark, main) and tables.Layout.of(table_properties(spark, kept)) == layout
    with pytest.raises(tables.TableNotEmpty):
        tables.snapshot_table(spark, main, kept)
    tables.save_table(rows(spark, [50]), main, "WRITE_APPEND")
    tables.save_table(rows(spark, [51]), main, "WRITE_APPEND")
    change_table(spark, main, rows(spark, [7, 60], "c"), spark.createDataFrame([(9,)], "k int"), "k")
    now = content(tables.whole_table(spark, main))
    assert len(now) == 32 and content(tables.whole_table(spark, kept)) == was
    tables.snapshot_table(spark, kept, later, dt.datetime(2999, 1, 1))
    tables.save_table(rows(spark, [70]), kept, "WRITE_APPEND")
    assert content(tables.whole_table(spark, main)) == now and content(tables.whole_table(spark, later)) == was
    retention.drop_old_files(spark, main)
    retention.drop_old_files(spark, kept)
    assert content(tables.whole_table(spark, main)) == now and content(tables.whole_table(spark, later)) == was
    assert tables.whole_table(spark, kept).count() == 31
    tables.save_table(rows(spark, [1]), main, "WRITE_TRUNCATE")
    retention.drop_tables(spark, [kept, later])
    assert retention.drop_old_files(spark, main) >= 1
    assert content(tables.whole_table(spark, main)) == content(rows(spark, [1]))
    assert {f.rsplit("/", 1)[0] for f in files(spark, main)} <= {"file:" + p.removeprefix("file:") for p in file_folders(spark.table(main))}


def test_a_partition_once_emptied_stays_empty(spark, schema):
    """Rows of an emptied partition do not come back when later rows fall in it."""

    name = f"{schema}.days"
    made = spark.createDataFrame([(1, DAY), (2, DAY), (3, DAY + dt.timedelta(days=1))], "id int, day date")
    tables.save_partitioned(made, name, "day")
    tables.drop_partition(spark, name, DAY)
    tables.drop_partition(spark, name, dt.date(1990, 1, 1))
    tables.save_table(spark.createDataFrame([(9, DAY)], made.schema), name, "WRITE_APPEND")
    assert sorted(r["id"] for r in tables.whole_table(spark, name).collect()) == [3, 9]
    tables.replace_partitions(spark.createDataFrame([(8, DAY), (7, None)], made.schema), name)
    tables.save_table(spark.createDataFrame([(6, None)], made.schema), name, "WRITE_APPEND")
    assert sorted(r["id"] for r in tables.whole_table(spark, name).collect()) == [3, 6, 7, 8]
    retention.drop_old_files(spark, name)
    assert sorted(r["id"] for r in tables.whole_table(spark, name).collect()) == [3, 6, 7, 8]


def test_hours_as_partitions(spark, schema):
    name = f"{schema}.hours"
    made = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5, 10)), (2, dt.datetime(2024, 1, 1, 6))], "id int, at timestamp")
    tables.save_partitioned(made, name, "at", "HOUR")
    tables.replace_partitions(made.limit(1).withColumn("id", F.lit(5)), name)
    tables.snapshot_table(spark, name, f"{schema}.kept")
    tables.drop_partition(spark, name, dt.datetime(2024, 1, 1, 6, 30))
    retention.drop_old_files(spark, name)
    assert [r["id"] for r in tables.whole_table(spark, name).collect()] == [5]
    assert sorted(r["id"] for r in tables.whole_table(spark, f"{schema}.kept").collect()) == [2, 5]
