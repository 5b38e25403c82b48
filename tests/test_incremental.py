import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relops.columns import ColumnMismatch
from relops.operators import compare
from relops.operators.incremental import apply_changes, delete_by_keys, merge_changefiles, upsert
from relops.plans.changefiles import changefile_lines, merge_changefile_texts
from relops.sinks.tables import save_bucketed

D = dt.date
WELLS = [
    ("alder", 41, D(2006, 2, 17)),
    ("birch", 12, D(2009, 11, 3)),
    ("cedar", 88, D(2012, 6, 25)),
    ("damson", 19, D(2015, 8, 9)),
    ("elm", 63, D(2018, 12, 30)),
    ("fir", 12, None),
]
# Two wells surveyed again, one deepened (another key), two dug anew.
SURVEYS = [
    ("cedar", 88, D(2021, 1, 5)),
    ("fir", 12, D(2022, 7, 7)),
    ("cedar", 90, D(2023, 3, 13)),
    ("gorse", 7, D(2020, 5, 22)),
    ("hazel", 30, None),
]
TYPES = "well string, depth int, surveyed date"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def wells(spark):
    return spark.createDataFrame(WELLS, TYPES)


def test_upsert_on_two_keys(spark, wells):
    merged = upsert(wells, spark.createDataFrame(SURVEYS, TYPES), ["well", "depth"])
    untouched = [w for w in WELLS if w[0] not in ("cedar", "fir")]
    assert rows(merged) == sorted(untouched + SURVEYS, key=repr)


def test_upsert_null_keys_never_match(spark):
    main = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    updates = spark.createDataFrame([(None, 10), (None, 11), ("a", 20), ("b", 30)], "k string, v int")
    assert rows(upsert(main, updates, "k")) == sorted([(None, 1), (None, 10), (None, 11), ("a", 20), ("b", 30)], key=repr)


def test_upsert_updates_every_match_and_replaces_structs_whole(spark):
    schema = "k int, s struct<a: int, b: int>"
    main = spark.createDataFrame([(1, (1, 1)), (1, (2, 2)), (2, (3, 3))], schema)
    updates = spark.createDataFrame([(1, (9, None))], schema)
    assert [(r[0], tuple(r[1])) for r in upsert(main, updates, "k").orderBy("k").collect()] == [
        (1, (9, None)),
        (1, (9, None)),
        (2, (3, 3)),
    ]


def test_upsert_inserts_repeated_new_keys_but_refuses_two_updates_of_one_row(spark):
    main = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(2, "b"), (2, "c")], "k int, v string")
    assert rows(upsert(main, twice, "k")) == [(1, "a"), (2, "b"), (2, "c")]
    with pytest.raises(PySparkException, match="several updates"):
        upsert(main, twice.withColumn("k", F.lit(1)), "k").collect()


def test_upsert_refuses_other_columns(spark, wells):
    with pytest.raises(ColumnMismatch):
        upsert(wells, wells.select("surveyed", "depth", "well"), "well")
    with pytest.raises(ColumnMismatch):
        upsert(wells, wells.withColumn("depth", F.lit("deep")), "well")
    with pytest.raises(ColumnMismatch):
        upsert(wells, wells, "owner")


def test_upsert_handles_odd_column_names(spark):
    main = spark.createDataFrame([(1, "a")], "`k.x` int, `v y` string")
    updates = spark.createDataFrame([(1, "b"), (2, "c")], main.schema)
    assert rows(upsert(main, updates, "k.x")) == [(1, "b"), (2, "c")]


def test_upsert_into_empty_and_with_nothing(spark, wells):
    none = wells.limit(0)
    assert rows(upsert(none, wells, "well")) == sorted(WELLS, key=repr)
    assert rows(upsert(wells, none, "well")) == sorted(WELLS, key=repr)


@pytest.mark.parametrize(
    "keys, delete_keys, left",
    [
        ("depth", "metres", "ace"),
        ("well", "filled", "ade"),
        (["depth", "well"], ["metres", "filled"], "acdef"),
    ],
)
def test_delete(spark, wells, keys, delete_keys, left):
    gone = spark.createDataFrame([("birch", 12), ("cedar", 19), ("fir", 19), ("birch", 12), ("yew", 1)], "filled string, metres int")
    kept = delete_by_keys(wells, gone, keys, delete_keys)
    assert sorted(r["well"][0] for r in kept.collect()) == list(left)


def test_delete_with_prefix(spark, wells):
    main = wells.withColumn("well", F.concat(F.lit("site/"), "well"))
    gone = spark.createDataFrame([("alder",), ("elm",), ("fir",), ("yew",)], "well string")
    assert delete_by_keys(main, gone, "well", delete_prefix="site/").count() == 3
    assert delete_by_keys(main, gone, "well").count() == 6


def test_delete_checks_keys_and_keeps_nulls(spark):
    main = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    gone = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(delete_by_keys(main, gone, "k")) == [(None, "b")]
    with pytest.raises(ColumnMismatch):
        delete_by_keys(main, gone.withColumn("k", F.col("k").cast("string")), "k")
    with pytest.raises(ColumnMismatch):
        delete_by_keys(main, gone, ["k", "v"], ["k"])


def test_changes_with_deletes_in_one_join(spark):
    main = spark.createDataFrame([(1, "a"), (1, "aa"), (2, "b"), (3, "c"), (None, "n")], "k int, v string")
    updates = spark.createDataFrame([(1, "A"), (4, "D"), (5, "E"), (None, "N")], "k int, v string")
    deletes = spark.createDataFrame([(2,), (2,), (5,), (9,), (None,)], "gone int")
    got = apply_changes(main, updates, deletes, "k", "gone")
    wanted = delete_by_keys(upsert(main, updates, "k"), deletes, "k", "gone")
    assert rows(got) == rows(wanted)
    assert rows(got) == sorted([(1, "A"), (1, "A"), (3, "c"), (4, "D"), (None, "n"), (None, "N")], key=repr)


def test_merge_keeps_all_rows_of_the_last_file(spark):
    changes = [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4), (None, 1, 5), (None, 3, 6)]
    df = spark.createDataFrame(changes, "k string, seq int, v int")
    assert rows(merge_changefiles(df, "k", "seq")) == sorted([("a", 2, 2), ("a", 2, 3), ("b", 1, 4), (None, 3, 6)], key=repr)
    with pytest.raises(ColumnMismatch):
        merge_changefiles(df, "missing", "seq")


@pytest.fixture()
def small_partitions(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hot_key_is_split(spark, small_partitions):
    ids = spark.range(300_000)
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k")
    main = ids.select(key, F.md5(F.col("id").cast("string")).alias("v")).repartition(8)
    few = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    for df in (
        upsert(main, few, "k"),
        delete_by_keys(main, few, "k"),
        merge_changefiles(main.withColumn("seq", F.lit(1)), "k", "seq"),
    ):
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_a_small_update_set_leaves_main_unshuffled(spark, tmp_path):
    path = str(tmp_path / "main")
    spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")).write.parquet(path)
    updates = spark.createDataFrame([(1, "y")], "k bigint, v string")
    merged = upsert(spark.read.parquet(path), updates, "k")
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("== Initial Plan ==")[0]


def test_a_bucketed_table_is_joined_where_it_lies(spark, schema, small_partitions):
    name = f"{schema}.main"
    save_bucketed(spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")), name, "k", 8)
    gone = spark.range(0, 1000, 2).select(F.col("id").alias("k"))
    kept = delete_by_keys(spark.table(name), gone, "k", co_located=True)
    assert kept.count() == 500
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    executed = kept._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in executed and plan
    main_side = executed.split("LeftAnti")[1].split("Bucketed: true")[0]
    assert "Exchange" not in main_side


def test_change_files_as_text(spark, tmp_path):
    contents = ['{"k":"a","v":1}\n{"k":null,"v":2}\n{"k":"b", "v":3}\n', '{"k":"a","v":4}\n{"k":"a","v":5}\n', '{"k":1,"v":6}\n{"k":"1","v":7}\n']
    paths = [str(tmp_path / f"c{i}.jsonl") for i in range(3)]
    for path, content in zip(paths, contents):
        with open(path, "w") as f:
            f.write(content)
    merge_changefile_texts(spark, paths, "k", str(tmp_path / "out"), delete_inputs=True)
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == sorted(
        ['{"k":null,"v":2}', '{"k":"b", "v":3}', '{"k":"a","v":4}', '{"k":"a","v":5}', '{"k":1,"v":6}', '{"k":"1","v":7}']
    )
    assert not os.path.exists(paths[0])
    with open(paths[0], "w") as f:
        f.write('{"v":1}')
    with pytest.raises(PySparkException, match="no k in line"):
        changefile_lines(spark, paths[:1], "k").collect()


def test_diff_ignores_the_order_of_map_entries(spark):
    shape = "k int, m map<string,map<string,int>>, s struct<l: array<map<int,string>>>"
    one = spark.createDataFrame([(1, {"a": {"x": 1, "y": 2}, "b": None}, ([{1: "p", 2: "q"}],)), (2, None, None), (3, {}, None)], shape)
    two = spark.createDataFrame([(1, {"b": None, "a": {"y": 2, "x": 1}}, ([{2: "q", 1: "p"}],)), (2, None, None), (3, None, None)], shape)
    assert [(r["k"], r["change"], r["field"]) for r in compare.table_diff(one, two, "k").collect()] == [(3, "value", "m")]


def test_verified_transfers_without_a_key_are_unchecked(spark):
    manifest = spark.createDataFrame([("a", "1", False), ("b", "2", False), ("b", "2", True), (None, "3", False), ("c", "4", True)], "key string, checksum string, retried boolean")
    arrived = spark.createDataFrame([("a", "1"), ("b", "9"), (None, "3")], "key string, checksum string")
    got = sorted((r["key"] or "", r["retried"], r["verdict"]) for r in compare.verify_transfers(manifest, arrived).collect())
    assert got == [("", False, "unchecked"), ("a", False, "ok"), ("b", False, "retry"), ("b", True, "error"), ("c", True, "unchecked")]
