import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from relops.operators import registry as reg
from relops.operators.asof import asof_join, latest_run_as_of
from relops.operators.compare import key_set_diff, table_diff, transfer_diff, verify_transfers
from relops.operators.rollups import transfer_rollup

UTC = dt.timezone.utc


def release(day, **more):
    at = dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(days=day)
    return reg.Release(dag_id="sales", entity_id="orders", created=at, modified=at, **more)


def test_registry(spark, schema):
    table = f"{schema}.releases"
    reg.seed_registry(spark, table)
    assert reg.is_first_release(spark.table(table), "sales", "orders")
    assert reg.latest_release(spark.table(table), "sales", "orders") is None
    snapshots = [dt.datetime(year, 6, 1, tzinfo=UTC) for year in (2024, 2022, 2023)]
    added = [release(i, snapshot_date=s, sequence_start=i, extra={"n": i}) for i, s in enumerate(snapshots)]
    for r in added:
        reg.add_release(spark, table, r)
    registry = spark.table(table)
    assert not reg.is_first_release(registry, "sales", "orders")
    assert reg.is_first_release(registry, "sales", "other")
    found = [reg.Release.from_row(r) for r in reg.get_releases(registry, "sales", "orders").collect()]
    assert found == added[::-1]
    assert reg.get_releases(registry, "sales", "orders", limit=2).count() == 2
    assert reg.latest_release(registry, "sales", "orders", "snapshot_date") == added[0]
    assert reg.Release.from_row(reg.latest_releases(registry, "snapshot_date").first()) == added[0]
    with pytest.raises(ValueError):
        reg.get_releases(registry, "sales", "orders", "dag_id")
    assert found[0].extra == {"n": 2}


def test_latest_puts_missing_dates_last(spark):
    registry = reg.release_frame(spark, [release(1), release(2, snapshot_date=dt.datetime(2020, 1, 1, tzinfo=UTC))])
    assert reg.latest_releases(registry, "snapshot_date").first()["snapshot_date"] == dt.datetime(2020, 1, 1)


def test_documents(spark, tmp_path):
    registry = reg.release_frame(spark, [release(1, extra={"a": [1]}), release(2)])
    documents = reg.release_to_json(registry).select("document")
    ids = [r["id"] for r in reg.write_release_documents(documents, "document", str(tmp_path)).collect()]
    assert len(set(ids)) == 2
    back = [reg.Release.from_row(reg.read_release_document(spark, str(tmp_path), i).first()) for i in ids]
    assert sorted(back, key=lambda r: r.created) == [release(1, extra={"a": [1]}), release(2)]
    many = documents.agg(F.concat(F.lit("["), F.array_join(F.collect_list("document"), ","), F.lit("]")).alias("d"))
    assert reg.release_from_json(many, "d").count() == 2


def runs(spark, *dates):
    day = [(dt.datetime(2024, m, d), dt.datetime(2024, m, d)) for m, d in dates]
    return spark.createDataFrame([("dag", a, b) for a, b in day], "dag_id string, logical_date timestamp, data_interval_end timestamp")


def test_latest_run(spark):
    request = spark.createDataFrame([("dag", dt.datetime(2024, 2, 11))], "dag_id string, data_interval_end timestamp")
    assert latest_run_as_of(request, runs(spark, (1, 7), (2, 7))).first()["latest_run"] == dt.datetime(2024, 2, 7)
    assert latest_run_as_of(request, runs(spark, (3, 1))).first()["latest_run"] is None
    assert latest_run_as_of(request, runs(spark)).first()["latest_run"] is None


@pytest.mark.parametrize("groups", [1, 3, 50])
def test_asof_against_brute_force(spark, groups):
    """Few groups over many small files: running maxima have to be carried from file to file."""

    rnd = random.Random(groups)
    right = [(rnd.randrange(groups), rnd.randrange(500), rnd.randrange(10_000)) for _ in range(600)]
    left = [(i, rnd.choice([None, *range(groups)]), rnd.choice([None, *range(-5, 505)])) for i in range(600)]
    left += [(1000 + i, 0, 250) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof_join(
            spark.createDataFrame(left, "i int, g int, t int"),
            spark.createDataFrame(right, "g int, t int, v int"),
            by="g", left_time="t", right_time="t", value=F.col("v"),
        ).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    wanted = [
        (i, g, t, max((v for g2, t2, v in right if None not in (g, t) and g2 == g and t2 <= t), default=None))
        for i, g, t in left
    ]
    assert [tuple(r) for r in got] == wanted


@pytest.mark.parametrize("kind, make", [("string", lambda v: f"v{v:05d}é"), ("timestamp", lambda v: dt.datetime(1900 + v % 500, 1, 1)), ("decimal(20,3)", lambda v: decimal.Decimal(v)), ("double", float), ("struct<a:string,b:int>", lambda v: (None if v % 4 == 0 else f"s{v % 3}", v))])
def test_asof_values_of_any_type(spark, kind, make):
    """Two keys, columns named like helpers, small batches: the running maximum goes on from batch to batch."""

    rnd = random.Random(3)
    right = [(rnd.choice("ab"), rnd.randrange(3), rnd.randrange(60), make(rnd.randrange(9999))) for _ in range(300)]
    left = [(i, rnd.choice([None, "a", "b", "c"]), rnd.randrange(3), rnd.choice([None, *range(-3, 64)]), i) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        joined = asof_join(
            spark.createDataFrame(left, "`__relops_g0` int, g string, h int, t int, latest int"),
            spark.createDataFrame(right, f"g string, h int, t int, v {kind}"),
            by=["g", "h"], left_time="t", right_time="t", value=F.col("v"),
        )
        got = {r[0]: r["latest"] for r in joined.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rank = lambda v: (v[0] is not None, v[0] or "", v[1]) if isinstance(v, tuple) else v
    assert {i: tuple(v) if isinstance(v, tuple) else v for i, v in got.items()} == {
        i: max((v for g2, h2, t2, v in right if (g2, h2) == (g, h) and t is not None and t2 <= t), key=rank, default=None) for i, g, h, t, _ in left
    }
    assert joined.columns == ["__relops_g0", "g", "h", "t", "latest"] and joined.schema["latest"].dataType.simpleString() == kind


def test_asof_shuffles_the_rows_once(spark):
    left = spark.createDataFrame([(1, 1, "x")], "g int, t int, wide string")
    plan = asof_join(left, left, by="g", left_time="t", right_time="t", value=F.col("t"))._jdf.queryExecution().executedPlan().toString()
    # Besides the sorted write before: one row a file, twice. The rows themselves are not shuffled again.
    assert plan.count(" Exchange hashpartitioning") <= 2 and "SortMergeJoin" not in plan


PEOPLE = [("Gisella", "Derya", 1), ("Adelaida", "Melis", 2), ("Melanie", "Magomedkhan", 3)]


def test_table_diff(spark):
    people = spark.createDataFrame(PEOPLE, "first_name string, last_name string, n int")
    assert table_diff(people, people.repartition(3), "first_name").isEmpty()
    fewer = people.filter("n < 3")
    assert [tuple(r) for r in table_diff(people, fewer, "first_name").collect()] == [("Melanie", "only_expected", None, None, None)]
    assert [r["change"] for r in table_diff(fewer, people, "first_name").collect()] == ["only_actual"]
    other = people.withColumn("n", F.when(F.col("n") == 2, None).otherwise(F.col("n"))).drop("last_name").withColumn("x", F.lit(None).cast("int"))
    got = sorted((tuple(r) for r in table_diff(people, other, "first_name").filter("first_name = 'Adelaida'").collect()), key=repr)
    assert got == [
        ("Adelaida", "field_only_actual", "x", None, None),
        ("Adelaida", "field_only_expected", "last_name", "Melis", None),
        ("Adelaida", "value", "n", "2", None),
    ]
    twice = people.union(people.limit(1))
    assert [(r["change"], r["expected"], r["actual"]) for r in table_diff(people, twice, "first_name").collect()] == [("duplicate_key", "1", "2")]


def test_table_diff_of_nested_values(spark):
    one = spark.createDataFrame([(1, [3, 1, 2], {"a": [2, 1]}, ([1, 2],))], "k int, l array<int>, m map<string, array<int>>, s struct<l: array<int>>")
    two = spark.createDataFrame([(1, [1, 2, 3], {"a": [1, 2]}, ([2, 1],))], one.schema)
    assert sorted(r["field"] for r in table_diff(one, two, "k").collect()) == ["l", "m", "s"]
    assert table_diff(one, two, "k", ignore_list_order=True).isEmpty()


def test_key_sets(spark):
    left = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert dict(map(tuple, key_set_diff(left, right, "k").collect())) == {1: "left", 2: "both", 3: "right", None: "both"}


def test_transfers(spark):
    source = spark.createDataFrame(
        [("a", "1", "md5"), ("b", "2", "md5"), ("c", "3", "md5"), ("d", "4", None), (None, "5", "md5")],
        "key string, checksum string, algorithm string",
    )
    target = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), (None, "5")], "key string, checksum string")
    status = {r["key"]: r["status"] for r in transfer_diff(source, target, algorithm="algorithm").collect()}
    assert status == {"a": "skip", "b": "changed", "c": "new", "d": "unverified", None: "new"}
    manifest = spark.createDataFrame(
        [("a", "1", False), ("b", "2", False), ("b2", "2", True), ("c", "3", False), ("d", None, False)],
        "key string, checksum string, retried boolean",
    )
    arrived = spark.createDataFrame([("a", "1"), ("b", "x"), ("b2", "x"), ("d", "4")], "key string, checksum string")
    verdict = {r["key"]: r["verdict"] for r in verify_transfers(manifest, arrived).collect()}
    assert verdict == {"a": "ok", "b": "retry", "b2": "error", "c": "unchecked", "d": "unchecked"}


def test_rollup(spark):
    operations = spark.createDataFrame(
        [("a", "SUCCESS", "3"), ("a", "SUCCESS", None), ("b", "SUCCESS", "1"), ("b", "FAILED", "1"), ("b", "ABORTED", "1"),
         ("c", "ABORTED", "1"), ("c", "IN_PROGRESS", "1"), ("d", "SUCCESS", "1"), ("d", "IN_PROGRESS", "2")],
        "job string, status string, objects_found string",
    )
    got = {r["job"]: (r["state"], r["n_objects"]) for r in transfer_rollup(operations).collect()}
    assert got == {"a": ("SUCCESS", 3), "b": ("FAILED", 3), "c": ("ABORTED", 2), "d": ("IN_PROGRESS", 3)}
