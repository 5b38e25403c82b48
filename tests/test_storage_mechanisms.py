"""Scratch folders with an end, exports by part, table facts, estimates by footers, filters that tables demand, lines in order."""

import datetime as dt
import gzip
import json
import os
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from relops.operators.asof import asof_join
from relops.operators.compare import stored_integrity, table_diff, transfer_diff, verify_transfers
from relops.plans import guard
from relops.plans.changefiles import changefile_lines, merge_changefile_texts
from relops.session import scratch_owner, scratch_path
from relops.sinks import export, tables
from relops.sizing import UNKNOWN_BYTES, read_bytes
from relops.sources.tables import PartitionFilterRequired, stored_facts, table_inventory
from relops.staging import stage

SF_DIR = "/root/testdata/sf0.001"


def test_nothing_is_left_of_an_owned_run(spark, tmp_path):
    root = spark.conf.get("spark.checkpoint.dir", None) or os.path.dirname(os.path.dirname(scratch_path(spark, "root")))
    held = lambda: set(os.listdir(f"{root.removeprefix('file:')}/relops"))
    outer = stage(spark.range(3), "outer")
    before = held()
    runs = spark.createDataFrame([("a", dt.datetime(2024, 1, d)) for d in range(1, 9)], "g string, at timestamp")
    with pytest.raises(ZeroDivisionError):
        with scratch_owner(spark) as folders:
            asof_join(runs, runs, by="g", left_time="at", right_time="at", value=F.col("at")).collect()
            with scratch_owner(spark) as inner:
                export.export_parts(runs, str(tmp_path / "parts"), ["at"], max_bytes=60)
            assert folders and inner and not set(folders) & set(inner)
            raise ZeroDivisionError
    assert held() == before and outer.count() == 3
    assert len(os.listdir(tmp_path / "parts")) > 3


@pytest.mark.parametrize("compress", [False, True])
def test_more_parts_than_shuffle_partitions(spark, tmp_path, compress):
    """Each part is a file of one task, parts are in order, bounded and not empty."""

    lines = spark.range(60_000 if compress else 4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(1).alias("__relops_o0"))
    limit = 4000
    tmp_path = tmp_path / "parts"
    export.export_parts(lines, str(tmp_path), ["id"], line="text", max_bytes=limit, compress=compress)
    parts = sorted(p for p in os.listdir(tmp_path) if p.startswith("part_file="))
    assert len(parts) > 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got, tasks = [], set()
    for part in parts:
        (name,) = [f for f in os.listdir(tmp_path / part) if f.startswith("part-")]
        tasks.add(name.split("-")[1])
        raw = (tmp_path / part / name).read_bytes()
        text = gzip.decompress(raw) if compress else raw
        assert text and (compress or len(raw) < limit + 65)
        got += text.decode().splitlines()
    assert got == [r["text"] for r in lines.orderBy("id").collect()] and len(tasks) == len(parts)


def test_compressed_sizes_are_those_of_a_flushed_stream():
    lines = ["x" * n + str(n) for n in (0, 5, 70_000, 3, 200_000, 64 * 1024 - 7, 9, 12)]
    for cuts in ([8], [3, 5], [1] * 8):
        stream, wanted, at = zlib.compressobj(wbits=zlib.MAX_WBITS | 16), [], 0
        batches = []
        for size in cuts:
            batch, waiting, pending = lines[at : at + size], 0, 0
            for i, line in enumerate(batch):
                pending += len(stream.compress(line.encode() + b"\n"))
                waiting += len(line) + 1
                closed = waiting >= 64 * 1024 or i == len(batch) - 1
                wanted.append(pending + len(stream.flush(zlib.Z_SYNC_FLUSH)) if closed else 0)
                waiting, pending = (0, 0) if closed else (waiting, pending)
            batches.append(pd.Series(batch))
            at += size
        got = pd.concat(export.compressed_run.func(iter(batches)))
        assert got["size"].tolist() == wanted and got["before"].tolist() == [sum(wanted[:i]) for i in range(8)]


def test_facts_of_all_tables_in_one_job(spark, schema):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, None), (3, dt.date(2024, 1, 2))], "id int, day date")
    names = [f"{schema}.{n}" for n in ("one", "days", "empty", "missing", "late", "text")]
    tables.save_table(rows, names[0])
    tables.save_partitioned(rows, names[1], "day")
    tables.save_table(rows.limit(0), names[2])
    tables.snapshot_table(spark, names[0], names[4], dt.datetime(2020, 1, 1))
    rows.select(F.col("id").cast("string")).write.format("text").saveAsTable(names[5])
    facts = {r["table_id"]: r for r in stored_facts(spark, [*names, names[0]]).collect()}
    assert [facts[n]["n_rows"] for n in names] == [3, 3, 0, None, None, 3]
    assert [facts[n]["exists"] for n in names] == [True, True, True, False, False, True]
    files = spark.table(names[1]).select("_metadata.file_path", "_metadata.file_size").distinct().collect()
    assert facts[names[1]]["n_bytes"] == sum(r["file_size"] for r in files) and facts[names[5]]["n_bytes"] is None
    listed = {r["table_id"]: r["n_rows"] for r in table_inventory(spark, schema, statistics=True).collect()}
    assert {n: listed[n] for n in names if n in listed} == {names[0]: 3, names[1]: 3, names[2]: 0, names[4]: None, names[5]: 3}
    stated = [(names[0], None, 3, facts[names[0]]["n_bytes"]), (names[1], True, 4, None), (names[3], False, None, None), (names[4], None, None, None), ("other", None, None, None)]
    expected = spark.createDataFrame(stated, "table_id string, exists boolean, expected_rows long, expected_bytes long")
    checked = {r["table_id"]: r["as_expected"] for r in stored_integrity(stored_facts(spark, names), expected).collect()}
    assert checked == {names[0]: True, names[1]: False, names[2]: True, names[3]: True, names[4]: False, names[5]: True, "other": False}
    assert stored_facts(spark, []).count() == 0


def test_estimates_by_footers(spark, schema, tmp_path):
    """A column counts with what it stores, not with a guess by its type."""

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    size = os.path.getsize(f"{SF_DIR}/documents.parquet")
    text, lang = (read_bytes(docs.select(c)) for c in ("text", "lang"))
    assert 0.9 * size < text <= size and lang < 0.02 * size and read_bytes(docs) <= size
    both = docs.alias("a").join(docs.select(F.col("doc_id").alias("x")), F.col("doc_id") == F.col("x")).select("lang", "x")
    assert lang < read_bytes(both) < lang + 0.2 * size
    assert read_bytes(spark.range(5)) == 0 and read_bytes(docs.limit(0)) == 0
    nested = spark.range(500).select(F.struct(F.sha2(F.col("id").cast("string"), 256).alias("wide"), F.lit(1).alias("thin")).alias("s"), F.array(F.lit(1)).alias("l"))
    nested.write.parquet(str(tmp_path / "nested"))
    stored = spark.read.parquet(str(tmp_path / "nested"))
    assert read_bytes(stored.select("s.thin")) * 5 < read_bytes(stored.select("s")) <= read_bytes(stored)
    stored.select("l").write.json(str(tmp_path / "json"))
    total = sum(os.path.getsize(tmp_path / "json" / f) for f in os.listdir(tmp_path / "json") if f.endswith(".json"))
    assert read_bytes(spark.read.json(str(tmp_path / "json"))) == total
    docs.createOrReplaceTempView("estimated_docs")
    inner = guard.estimate_bytes(spark, "SELECT 1 AS x WHERE 3 < (SELECT count(text) FROM estimated_docs)")
    assert inner >= text
    assert UNKNOWN_BYTES > 0


def test_many_files_are_sampled(spark, tmp_path):
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).repartition(150).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    total = sum(os.path.getsize(tmp_path / "many" / f) for f in os.listdir(tmp_path / "many") if f.endswith(".parquet"))
    assert 0.8 * total < read_bytes(many) < 1.1 * total and read_bytes(many.select("t")) > 0.7 * total


def test_a_required_filter_holds_on_every_path(spark, schema):
    name = f"{schema}.days"
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2))], "id int, day date")
    tables.save_partitioned(rows, name, "day", require_filter=True)
    day = "day_day = '2024-01-01'"
    refused = [
        lambda sql: guard.guarded_query(spark, sql),
        lambda sql: tables.table_from_query(spark, sql, f"{schema}.made"),
        lambda sql: guard.run_template(spark, sql),
    ]
    for run in refused:
        for sql in (f"SELECT * FROM {name}", f"SELECT id FROM {name} WHERE id = 1", f"SELECT 1 AS x WHERE 1 < (SELECT max(id) FROM {name})"):
            with pytest.raises(PartitionFilterRequired):
                run(sql)
        run(f"SELECT id FROM {name} WHERE {day}")
    assert [r["id"] for r in guard.run_template(spark, "SELECT id FROM IDENTIFIER(:t) WHERE day_day > :d", {"t": name, "d": "2024-01-01"}).collect()] == [2]


def test_lines_of_change_files_in_their_order(spark, tmp_path):
    """Files in the order given, their lines in theirs, also where a file has many splits; one scan for all files."""

    made, paths = {}, []
    for name, count in (("z", 300), ("a", 200), ("m", 400)):
        made[name] = [json.dumps({"k": f"{name}{i}" if i % 3 else i, "pad": "x" * 30}) for i in range(count)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(made[name]) + "\n\n")
        paths.append(str(tmp_path / f"{name}.jsonl"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = changefile_lines(spark, paths, "k")
        assert lines._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1
        got = [r["value"] for r in lines.orderBy("seq", "place").collect()]
        assert got == [*made["z"], *made["a"], *made["m"]]
        merge_changefile_texts(spark, paths, "k", str(tmp_path / "out"))
        last = {json.loads(line)["k"]: n for n, name in enumerate("zam") for line in made[name]}
        want = [line for n, name in enumerate("zam") for line in made[name] if last[json.loads(line)["k"]] == n]
        out = [f for f in sorted(os.listdir(tmp_path / "out")) if f.startswith("part-")]
        assert [line for f in out for line in (tmp_path / "out" / f).read_text().splitlines()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_columns_named_like_helpers_everywhere(spark):
    old = "_time _g0 _value _side _key _found _e _a _n_e _n_a _d0".split()
    schema = "k string, at timestamp, checksum string, key string, retried boolean, " + ", ".join(f"{n} string" for n in old)
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), "c", "key", False, *old)], schema)
    assert asof_join(rows, rows, by="_g0", left_time="at", right_time="at", value=F.col("k")).first()["latest"] == "a"
    assert table_diff(rows, rows.withColumn("_a", F.lit("x")), ["_e"]).first()["field"] == "_a"
    assert transfer_diff(rows, rows).first()["status"] == "skip" and verify_transfers(rows, rows).first()["verdict"] == "ok"
    from relops.operators.incremental import delete_by_keys

    assert delete_by_keys(rows, rows, "_d0").count() == 0
