"""Many small parts share tasks, lines go to Python in bounded batches, large bucketed tables get more buckets."""

import os

from pyspark.sql import functions as F

from relops.operators.incremental import delete_by_keys
from relops.sinks import export, tables
from relops.versions import table_facts


def test_many_small_parts_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "PART_TASKS", 10)
    path = tmp_path / "parts"
    lines = spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    export.export_parts(lines, str(path), ["id"], line="text", max_bytes=4000)
    parts = sorted(p for p in os.listdir(path) if p.startswith("part_file="))
    assert len(parts) == -(-2000 * 65 // 4000)
    got, tasks = [], []
    for part in parts:
        (name,) = [f for f in os.listdir(path / part) if f.startswith("part-")]
        tasks.append(name.split("-")[1])
        got += (path / part / name).read_text().splitlines()
    assert got == [r["text"] for r in lines.orderBy("id").collect()]
    # Consecutive parts, four a task.
    assert len(set(tasks)) == -(-len(parts) // 4) and tasks == sorted(tasks)


def test_lines_are_compressed_in_bounded_batches(spark, tmp_path, monkeypatch):
    seen, numbered = [], export._numbered

    def noted(*args):
        seen.append(int(spark.conf.get(export.BATCH_CONF)))
        return numbered(*args)

    monkeypatch.setattr(export, "_numbered", noted)
    before = spark.conf.get(export.BATCH_CONF)
    spark.conf.set(export.BATCH_CONF, 10_000)
    try:
        export.export_parts(spark.range(10), str(tmp_path / "parts"), ["id"], compress=True)
        assert seen == [export.BATCH_ROWS] and spark.conf.get(export.BATCH_CONF) == "10000"
    finally:
        spark.conf.set(export.BATCH_CONF, before)


def test_a_large_bucketed_table_has_more_buckets(spark, schema, tmp_path, monkeypatch):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    rows.write.parquet(str(tmp_path / "rows"))
    stored, name = spark.read.parquet(str(tmp_path / "rows")), f"{schema}.main"
    tables.save_bucketed(stored, name, "k", 4)
    assert table_facts(spark, name)["Num Buckets"] == "4"
    monkeypatch.setattr(tables, "BUCKET_BYTES", 8 * 1024)
    tables.save_bucketed(stored, name, "k", 4)
    number = int(table_facts(spark, name)["Num Buckets"])
    assert number > 4 and number % 4 == 0
    tables.save_bucketed(spark.range(4000, 4010).select(F.col("id").alias("k"), F.lit("x").alias("v")), name, "k", 4, tables.WRITE_APPEND)
    kept = delete_by_keys(spark.table(name), spark.range(0, 4000, 2).select(F.col("id").alias("k")), "k", co_located=True)
    assert sorted(r["k"] for r in kept.collect()) == [*range(1, 4000, 2), *range(4000, 4010)]
