import datetime as dt
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import ColumnMismatch
from relops.operators.rollups import expired
from relops.operators.shards import NoShard, latest_table, shard_dates
from relops.plans import guard
from relops.plans.merge import delete_from_table, upsert_table
from relops.plans.releases import Target, apply_changefile_release, apply_partition_release, apply_snapshot_release
from relops.session import scratch_path
from relops.sinks import retention, tables
from relops.sources import schemas
from relops.sources.records import records_to_df
from relops.sources.tables import (
    PartitionFilterRequired,
    TableMissing,
    list_schemas,
    read_table,
    scan_shards,
    table_exists,
    table_inventory,
    table_names,
    table_properties,
)

FAILURES = (PySparkException, Py4JJavaError)
HERBS = [
    {"herb": "sorrel", "bed": "north wall", "sown": "2013-05-02"},
    {"herb": "lovage", "bed": "pond", "sown": "2004-10-19"},
    {"herb": "chervil", "bed": "frame", "sown": "2011-08-23"},
    {"herb": "dill", "bed": "pond", "sown": "1996-01-30"},
    {"herb": "tansy", "bed": "hedge", "sown": "2019-06-14"},
]
FIELDS = [
    {"name": "herb", "type": "STRING", "mode": "REQUIRED", "description": "common name"},
    {"name": "bed", "type": "STRING"},
    {"name": "sown", "type": "DATE", "mode": "NULLABLE"},
]
HERBS_SCHEMA = schemas.schema_from_fields(FIELDS)


@pytest.fixture()
def herbs(spark):
    return records_to_df(spark, HERBS, HERBS_SCHEMA)


def test_schema_file(spark, tmp_path):
    path = tmp_path / "herbs.json"
    path.write_text(json.dumps(FIELDS + [{"name": "tags", "type": "RECORD", "mode": "REPEATED", "fields": FIELDS[:1]}]))
    schema = schemas.schema_from_json(spark, str(path))
    assert schema["sown"].dataType == T.DateType()
    assert not schema["herb"].nullable
    assert schema["herb"].metadata == {"comment": "common name"}
    assert schema["tags"].dataType.simpleString() == "array<struct<herb:string>>"
    with pytest.raises(ValueError):
        schemas.schema_from_fields([{"name": "x", "type": "GEOMETRY"}])


def test_records(spark, herbs):
    assert herbs.count() == 5
    assert herbs.filter("herb = 'sorrel'").first()["sown"] == dt.date(2013, 5, 2)
    with pytest.raises(ColumnMismatch):
        records_to_df(spark, [{"herb": "x", "age": 3}], HERBS_SCHEMA)
    with pytest.raises(FAILURES):
        records_to_df(spark, [{"bed": "x"}], HERBS_SCHEMA).collect()
    with pytest.raises(FAILURES):
        records_to_df(spark, [{"herb": "x", "sown": "soon"}], HERBS_SCHEMA).collect()
    found = records_to_df(spark, [{"a": 1, "b": {"c": [1.5]}}, {"a": 2}])
    assert sorted(found.columns) == ["a", "b"]
    assert [r["a"] for r in found.orderBy("a").collect()] == [1, 2]


def test_conform(spark, herbs):
    assert schemas.conform(herbs.drop("sown"), HERBS_SCHEMA).first()["sown"] is None
    with pytest.raises(ColumnMismatch):
        schemas.conform(herbs.withColumn("x", F.lit(1)), HERBS_SCHEMA)
    with pytest.raises(ColumnMismatch):
        schemas.conform(herbs.withColumn("sown", F.lit("x")), HERBS_SCHEMA)
    with pytest.raises(ColumnMismatch):
        schemas.conform(herbs.drop("herb"), HERBS_SCHEMA)


def test_find_schema(spark):
    files = spark.createDataFrame(
        [(f"/s/{n}",) for n in ("table_a.json", "table_b_1900-01-01.json", "table_b_2000-01-01.json", "table_bc_2010-01-01.json")],
        "path string",
    )
    d = dt.date

    def find(*args, **kwargs):
        return schemas.find_schema(files, *args, **kwargs)

    assert find("table_a") == "/s/table_a.json"
    assert find("table_a", d(2020, 1, 1)) is None
    assert find("table_b", d(2022, 11, 11)) == "/s/table_b_2000-01-01.json"
    assert find("b", d(2022, 11, 11), prefix="table_") == "/s/table_b_2000-01-01.json"
    assert find("table_b", d(1950, 11, 11)) == "/s/table_b_1900-01-01.json"
    assert find("table_b", d(1000, 1, 1)) is None
    assert find("table_b") is None


def test_dispositions(spark, schema, herbs):
    name = f"{schema}.herbs"
    tables.save_table(herbs, name, description="five herbs", labels={"team": "x"})
    assert spark.table(name).count() == 5
    assert table_properties(spark, name)["relops.label.team"] == "x"
    with pytest.raises(tables.TableNotEmpty):
        tables.save_table(herbs, name)
    tables.save_table(herbs, name, "WRITE_APPEND")
    assert spark.table(name).count() == 10
    with pytest.raises(ColumnMismatch):
        tables.save_table(herbs.withColumn("x", F.lit(1)), name, "WRITE_APPEND")
    tables.save_table(herbs.limit(1), name, "WRITE_TRUNCATE")
    assert spark.table(name).count() == 1
    assert table_properties(spark, name)["relops.label.team"] == "x"
    tables.save_table(herbs.limit(0), name, "WRITE_TRUNCATE")
    tables.save_table(herbs, name, "WRITE_EMPTY")
    assert spark.table(name).count() == 5
    tables.set_description(spark, name, "it's new")
    assert "it's new" in [r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()]
    with pytest.raises(ValueError):
        tables.save_table(herbs, name, "WRITE_SOMEHOW")


def test_a_failed_load_changes_nothing(spark, schema, herbs):
    name = f"{schema}.herbs"
    tables.save_table(herbs, name)
    bad = herbs.withColumn("sown", F.when(F.col("herb") == "tansy", F.raise_error(F.lit("bad")).cast("date")).otherwise(F.col("sown")))
    with pytest.raises(FAILURES):
        tables.save_table(bad, name, "WRITE_TRUNCATE")
    assert spark.table(name).count() == 5


def test_partitions(spark, schema, herbs):
    name = f"{schema}.herbs"
    tables.save_partitioned(herbs, name, "sown", "YEAR", require_filter=True, cluster_by=["herb"])
    with pytest.raises(PartitionFilterRequired):
        read_table(spark, name)
    kept = read_table(spark, name, start=dt.date(2011, 1, 1), end=dt.date(2015, 1, 1))
    assert sorted(r["herb"] for r in kept.collect()) == ["chervil", "sorrel"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sown_year" in plan
    with pytest.raises(ValueError):
        tables.save_partitioned(herbs, name, "sown", "WEEK")
    tables.replace_partitions(herbs.filter("herb = 'tansy'").withColumn("bed", F.lit("New")), name)
    rows = read_table(spark, name, start=dt.date(1900, 1, 1)).collect()
    assert len(rows) == 5 and {r["bed"] for r in rows if r["herb"] == "tansy"} == {"New"}


def test_table_from_query(spark, schema):
    sql = "SELECT 'a' AS name, DATE '2024-01-01' AS date UNION ALL SELECT :other, DATE '2024-01-02'"
    wanted = schemas.schema_from_fields([{"name": "name", "type": "STRING"}, {"name": "date", "type": "DATE"}])
    name = f"{schema}.made"
    for given in (None, wanted):
        tables.table_from_query(spark, sql, name, args={"other": "b"}, schema=given, cluster_by=["name"], bytes_budget=0)
        assert spark.table(name).count() == 2
    with pytest.raises(ColumnMismatch):
        tables.table_from_query(spark, "SELECT 1 AS name", name, schema=wanted)
    tables.save_table(spark.range(100), f"{schema}.numbers")
    for query, budget in ((f"SELECT * FROM {schema}.numbers", 1), ("SELECT 1 AS x", -1)):
        with pytest.raises(guard.BudgetExceeded):
            tables.table_from_query(spark, query, name, bytes_budget=budget)
    assert spark.table(name).count() == 2


def test_budget(spark, schema):
    guard.check_budget(10, 10)
    with pytest.raises(guard.BudgetExceeded):
        guard.check_budget(9, 10)
    for bad in ((None, 1), (1, None), (1.5, 1), ("1", 1)):
        with pytest.raises(TypeError):
            guard.check_budget(*bad)
    name = f"{schema}.wide"
    tables.save_table(spark.range(1000).select("id", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))).alias(f"c{i}") for i in range(8)]), name)
    whole = guard.estimate_bytes(spark, f"SELECT * FROM {name}")
    narrow = guard.estimate_bytes(spark, f"SELECT id FROM {name} WHERE id > :x", {"x": 3})
    assert 0 < narrow < whole / 5
    assert guard.estimate_bytes(spark, "SELECT 1 AS x") == 0


def test_snapshot_expiry(spark, schema, herbs):
    source, kept, gone = (f"{schema}.{n}" for n in ("herbs", "kept", "gone"))
    tables.save_table(herbs, source)
    tables.snapshot_table(spark, source, kept)
    tables.snapshot_table(spark, source, gone, dt.datetime(2024, 1, 1))
    assert table_exists(spark, kept) and not table_exists(spark, gone)
    assert read_table(spark, gone, now=dt.datetime(2023, 12, 31, tzinfo=dt.timezone.utc)).count() == 5
    with pytest.raises(TableMissing):
        read_table(spark, gone)
    with pytest.raises(tables.TableNotEmpty):
        tables.snapshot_table(spark, source, kept)


def test_views(spark, schema):
    name = f"{schema}.v"
    tables.create_view(spark, name, "SELECT 1 AS x")
    tables.create_view(spark, name, "SELECT 2 AS x")
    assert spark.table(name).first()["x"] == 2
    with pytest.raises(AnalysisException):
        tables.create_view(spark, name, "SELECT 3 AS x", replace=False)


def test_shards(spark, schema, herbs):
    base = f"{schema}.herbs"
    for month in (5, 6, 7):
        tables.save_table(herbs.limit(month), f"{base}2019{month:02d}01")
    tables.save_table(herbs, f"{base}_v20200101")
    listing = table_names(spark, schema)
    for month in (5, 6, 7):
        day = dt.date(2019, month, 1)
        assert shard_dates(listing, base, day).first()["shard_date"] == day
        assert latest_table(listing, base, day) == f"{base}2019{month:02d}01"
    assert [r[0].month for r in shard_dates(listing, base, limit=None).collect()] == [7, 6, 5]
    assert latest_table(listing, base, sharded=False) == base
    with pytest.raises(NoShard):
        latest_table(listing, base, dt.date(2018, 1, 1))
    assert scan_shards(spark, base, dt.date(2019, 6, 1)).groupBy("shard_date").count().count() == 2
    with pytest.raises(TableMissing):
        scan_shards(spark, f"{schema}.nothing")


def test_inventory(spark, schema, herbs):
    tables.save_table(herbs, f"{schema}.herbs")
    tables.save_table(herbs.limit(0), f"{schema}.other")
    tables.create_view(spark, f"{schema}.herbs_view", "SELECT 1 AS x")
    rows = {r["table_id"].split(".")[-1]: r for r in table_inventory(spark, schema, "herbs", statistics=True).collect()}
    assert set(rows) == {"herbs", "herbs_view"}
    assert rows["herbs"]["n_rows"] == 5 and rows["herbs"]["n_bytes"] > 0
    assert schema.split(".")[-1] in list_schemas(spark, "relops_")
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=30)
    assert retention.drop_expired(spark, table_inventory(spark, schema), 48, later, schema) == []
    dropped = retention.drop_expired(spark, table_inventory(spark, schema), 24, later, schema)
    assert sorted(dropped) == [f"{schema}.herbs", f"{schema}.other"]
    assert not table_exists(spark, f"{schema}.herbs")
    retention.drop_tables(spark, dropped)
    retention.drop_schemas(spark, [schema, schema])
    assert schema.split(".")[-1] not in list_schemas(spark)


def test_old_files(spark, schema, herbs):
    name = f"{schema}.herbs"
    for _ in range(3):
        tables.save_table(herbs, name, "WRITE_TRUNCATE")
    assert retention.drop_old_files(spark, name) == 2
    assert spark.table(name).count() == 5
    path = scratch_path(spark, "prefix")
    herbs.write.json(path)
    assert retention.delete_prefix(spark, path) and not retention.delete_prefix(spark, path)


def test_expired_is_fractional(spark):
    df = spark.createDataFrame([("a_1", dt.datetime(2024, 1, 1)), ("b_1", dt.datetime(2024, 1, 1))], "name string, created timestamp")
    at = dt.datetime(2024, 1, 1, 1, 30)
    assert expired(df, 1.5, at, prefix="a_").count() == 1
    assert expired(df, 1.51, at, prefix="a_").count() == 0


def test_load_tables(spark, schema):
    specs = [
        tables.TableSpec(schema_name=schema, table_name="herbs", records=HERBS, schema=HERBS_SCHEMA, is_sharded=True),
        tables.TableSpec(schema_name=schema, table_name="all_herbs", records=HERBS, schema=HERBS_SCHEMA),
    ]
    names = tables.load_tables(spark, specs, dt.date(2024, 1, 2))
    assert names == [f"{schema}.herbs20240102", f"{schema}.all_herbs"]
    assert all(spark.table(n).count() == 5 for n in names)


def test_clustering_spreads_a_hot_value(spark, schema):
    name = f"{schema}.hot"
    df = spark.range(100_000).select((F.col("id") % 3 > 0).cast("int").alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.save_clustered(df, name, "k")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in spark.table(name).groupBy(F.input_file_name().alias("f")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 100_000 / 8


def test_a_hot_partition_is_written_by_several_tasks(spark, schema):
    day = F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("date")
    df = spark.range(200_000).select(day.alias("day"), F.md5(F.col("id").cast("string")).alias("v")).repartition(8)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1MB")
    try:
        tables.save_partitioned(df, f"{schema}.hot", "day")
    finally:
        spark.conf.set(size, before)
    rows = spark.table(f"{schema}.hot").select("day_day", F.col("_metadata.file_path").alias("file")).distinct()
    files = rows.groupBy("day_day").agg(F.count("file").alias("n"))
    assert all(r["n"] > 2 for r in files.collect())


def target(schema, table):
    return Target(table=f"{schema}.{table}", registry=f"{schema}.releases", dag_id="d", entity_id=table)


def test_changefile_release_registers_and_snapshots(spark, schema):
    t = target(schema, "main")
    tables.save_table(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), t.table)
    changes = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (4, "d", 1)], "k int, v string, seq int")
    deletes = spark.createDataFrame([(2,)], "k int")
    at = dt.datetime(2024, 1, 1)
    out = apply_changefile_release(
        spark, t, changes, deletes, "k", "seq", start_date=at, end_date=at, now=at, snapshot=f"{schema}.before"
    )
    assert sorted(map(tuple, out.collect())) == [(1, "new"), (3, "c"), (4, "d")]
    assert spark.table(f"{schema}.before").count() == 3
    row = spark.table(t.registry).first()
    assert (row["entity_id"], int(row["sequence_start"]), int(row["sequence_end"])) == ("main", 1, 2)


def test_snapshot_and_partition_releases(spark, schema, herbs):
    at = dt.datetime(2024, 1, 1)
    t = target(schema, "herbs")
    assert apply_snapshot_release(spark, t, herbs, at, at, HERBS_SCHEMA).count() == 5
    with pytest.raises(tables.TableNotEmpty):
        apply_snapshot_release(spark, t, herbs, at, at)
    p = target(schema, "daily")
    for rows, day in ((herbs, 1), (herbs, 2), (herbs.limit(1), 2)):
        apply_partition_release(spark, p, rows, dt.datetime(2024, 1, day), at)
    assert spark.table(p.table).groupBy("snapshot_date_day").count().orderBy("snapshot_date_day").collect() == [
        ("2024-01-01", 5),
        ("2024-01-02", 1),
    ]
    assert read_table(spark, p.table).columns == [*herbs.columns, "snapshot_date"]
    assert spark.table(t.registry).count() == 4


def test_load_files(spark, schema, tmp_path):
    lines = [json.dumps(p) for p in HERBS]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text(json.dumps({"herb": "New", "sown": "2019-03-03"}))
    (tmp_path / "a.csv").write_text("herb,bed,sown\n" + "\n".join(",".join(p.values()) for p in HERBS))
    both = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
    name = f"{schema}.herbs"
    layout = tables.Layout(partition_field="sown", partition_kind="YEAR", cluster_by=("herb",))
    assert tables.load_files(spark, both, name, HERBS_SCHEMA, "jsonl", layout=layout, description="all")
    assert not tables.load_files(spark, both, name, HERBS_SCHEMA, "jsonl")
    assert tables.load_files(spark, str(tmp_path / "a.csv"), name, HERBS_SCHEMA, "csv", "WRITE_APPEND", skip_rows=1)
    assert read_table(spark, name).count() == 11
    assert spark.table(name).filter("sown_year = '2019'").count() == 3
    (tmp_path / "bad.jsonl").write_text('{"herb": "x", "sown": "soon"}')
    (tmp_path / "missing.jsonl").write_text('{"bed": "x"}')
    (tmp_path / "extra.jsonl").write_text('{"herb": "x", "age": 3}')
    for bad in ("bad", "missing", "extra"):
        assert not tables.load_files(spark, str(tmp_path / f"{bad}.jsonl"), f"{schema}.{bad}", HERBS_SCHEMA, "jsonl")
    extra = str(tmp_path / "extra.jsonl")
    assert tables.load_files(spark, extra, f"{schema}.extra", HERBS_SCHEMA, "jsonl", ignore_unknown=True)
    assert tables.load_records(spark, HERBS, f"{schema}.r") and tables.load_records(spark, HERBS, f"{schema}.r")
    assert not tables.load_records(spark, [{"age": 3}], f"{schema}.r", HERBS_SCHEMA)
    assert spark.table(f"{schema}.r").count() == 5


@pytest.mark.parametrize(
    "layout", [{}, {"partition_field": "day", "require_filter": True}, {"bucket_by": ("k",), "buckets": 4}, {"cluster_by": ("v",)}]
)
def test_stored_tables_keep_their_layout(spark, schema, layout):
    day = dt.date(2024, 1, 1)
    main, updates, gone = (f"{schema}.{n}" for n in ("main", "updates", "gone"))
    rows = spark.createDataFrame([(1, "a", day), (2, "b", day), (3, "c", None)], "k int, v string, day date")
    layout = tables.Layout(**layout)
    tables.save_table(rows, main, layout=layout)
    tables.save_table(spark.createDataFrame([(1, "A", day), (4, "D", day)], rows.schema), updates)
    tables.save_table(spark.createDataFrame([("2",)], "id string"), gone)
    upsert_table(spark, main, updates, "k")
    delete_from_table(spark, main, updates, "k")
    tables.save_table(rows.limit(1).withColumn("k", F.lit(4)), main, "WRITE_APPEND")
    tables.save_table(spark.createDataFrame([(2,)], "id int"), gone, "WRITE_TRUNCATE")
    delete_from_table(spark, main, gone, "k", "id")
    assert sorted(r["k"] for r in tables.whole_table(spark, main).collect()) == [3, 4]
    assert tables.Layout.of(table_properties(spark, main)) == layout
    with pytest.raises(guard.BudgetExceeded):
        upsert_table(spark, main, updates, "k", bytes_budget=0)
    tables.snapshot_table(spark, main, f"{schema}.kept")
    assert tables.Layout.of(table_properties(spark, f"{schema}.kept")) == layout


def test_only_rows_reject_a_load(spark, schema, tmp_path, monkeypatch):
    """What is no fault of the rows is raised: an unknown format, a job that failed for another reason."""

    (tmp_path / "a.jsonl").write_text('{"herb": "x"}')
    with pytest.raises(ValueError):
        tables.load_files(spark, str(tmp_path / "a.jsonl"), f"{schema}.a", T.StructType.fromDDL("herb string"), "avro")

    def aborted(*args, **kwargs):
        raise PySparkException("Job aborted due to stage failure: ExecutorLostFailure (executor 3 exited)")

    monkeypatch.setattr(tables, "save_table", aborted)
    with pytest.raises(PySparkException, match="ExecutorLost"):
        tables.load_files(spark, str(tmp_path / "a.jsonl"), f"{schema}.a", T.StructType.fromDDL("herb string"), "jsonl")


def test_old_schemas(spark, schema, herbs):
    """Whole schemas go by age and prefix; the current one and those of unknown age stay."""

    from relops.sources.tables import schema_inventory
    from relops.workload.base import scratch_schema

    other, empty = scratch_schema(spark), scratch_schema(spark)
    tables.save_table(herbs, f"{schema}.herbs")
    tables.save_table(herbs, f"{other}.herbs")
    short = [s.split(".")[-1] for s in (schema, other, empty)]
    found = {r["name"]: r for r in schema_inventory(spark, "relops_").collect()}
    assert [found[s]["n_tables"] for s in short] == [1, 1, 0] and found[short[0]]["created"] is not None
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=30)
    listed = schema_inventory(spark, short[1])
    assert retention.drop_expired_schemas(spark, listed, 48, later, "relops_") == []
    assert retention.drop_expired_schemas(spark, listed, 24, later, "other") == []
    spark.catalog.setCurrentDatabase(short[0])
    try:
        assert retention.drop_expired_schemas(spark, schema_inventory(spark, short[0]), 24, later, "relops_") == []
        assert retention.drop_expired_schemas(spark, listed, 24, later, "relops_") == [short[1]]
    finally:
        spark.catalog.setCurrentDatabase("default")
    assert short[1] not in list_schemas(spark) and short[0] in list_schemas(spark)
