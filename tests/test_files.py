import csv
import datetime as dt
import gzip
import json
import os
import uuid

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.sinks import export
from relops.sources import files
from relops.sources.schemas import schema_from_fields
from relops.staging import with_row_index, with_sum_before, running_size

FAILURES = (PySparkException, Py4JJavaError)
NAMES = [("ore", "Kiruna"), ("slate", "Llanberis"), ("amber", "Yantarny")]
NAME_SCHEMA = schema_from_fields([{"name": "kind", "type": "STRING"}, {"name": "place", "type": "STRING"}])


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def name_files(tmp_path):
    text = "kind,place\n" + "".join(f"{a},{b}\n" for a, b in NAMES)
    lines = "".join(json.dumps({"kind": a, "place": b}) + "\n" for a, b in NAMES)
    (tmp_path / "n.csv").write_text(text)
    (tmp_path / "n.jsonl").write_text(lines)
    for name, content in (("n.csv.gz", text), ("n.jsonl.gz", lines)):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(content)
    return tmp_path


def test_same_rows_from_all_four(spark, name_files):
    for ext in ("csv", "csv.gz"):
        assert rows(files.scan_csv(spark, str(name_files / f"n.{ext}"), NAME_SCHEMA, skip_rows=1)) == sorted(NAMES)
        assert rows(files.scan_csv(spark, str(name_files / f"n.{ext}"))) == sorted(NAMES)
    for ext in ("jsonl", "jsonl.gz"):
        assert rows(files.scan_jsonl(spark, str(name_files / f"n.{ext}"), NAME_SCHEMA)) == sorted(NAMES)
        assert rows(files.scan_jsonl(spark, str(name_files / f"n.{ext}"))) == sorted(NAMES)
    both = [str(name_files / "n.jsonl"), str(name_files / "n.jsonl.gz")]
    loaded = files.with_source_file(files.scan_jsonl(spark, both, NAME_SCHEMA))
    assert loaded.groupBy("source_file").count().count() == 2


def test_csv_options(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("banner\nsecond\na;b\n'x;1';2\n")
    schema = T.StructType.fromDDL("a string, b string")
    got = files.scan_csv(spark, str(path), schema, sep=";", quote="'", skip_rows=3)
    assert rows(got) == [("x;1", "2")]
    path.write_text('a,b\n"two\nlines",2\n')
    assert files.scan_csv(spark, str(path), schema, skip_rows=1, multiline=True).first()["a"] == "two\nlines"
    with pytest.raises(ValueError):
        files.scan_csv(spark, str(path), schema, skip_rows=2, multiline=True)
    path.write_text("1\nx\n")
    with pytest.raises(FAILURES):
        files.scan_csv(spark, str(path), T.StructType.fromDDL("a int")).collect()


def test_missing_values_without_a_schema(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("n,s,t\n1.5,a,2024-01-01\nNaN,NA,2024-01-02\n,None,\n")
    got = [tuple(r) for r in files.scan_csv(spark, str(path)).orderBy(F.col("n").desc_nulls_last(), "t").collect()]
    assert got[0] == (1.5, "a", dt.date(2024, 1, 1))
    assert sorted(map(repr, got[1:])) == sorted([repr((None, None, dt.date(2024, 1, 2))), repr((None, None, None))])


def test_skip_rows_in_files_of_many_splits(spark, tmp_path):
    for n in range(3):
        body = "".join(f"{n},{i}\n" for i in range(2000))
        (tmp_path / f"f{n}.csv").write_text("one\ntwo\nthree\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.scan_csv(spark, str(tmp_path), T.StructType.fromDDL("n int, i int"), skip_rows=3)
        assert got.rdd.getNumPartitions() > 3
        assert [tuple(r) for r in got.groupBy("n").agg(F.count("i"), F.sum("i")).orderBy("n").collect()] == [
            (n, 2000, 1999000) for n in range(3)
        ]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unknown_and_bad_fields(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"kind":"a","place":"b"}\n{"kind":"c","extra":{"deep":1}}\n')
    with pytest.raises(FAILURES, match="fields not in the schema: extra"):
        files.scan_jsonl(spark, str(path), NAME_SCHEMA).collect()
    assert files.scan_jsonl(spark, str(path), NAME_SCHEMA, ignore_unknown=True).count() == 2
    nested = schema_from_fields(
        [*[{"name": n, "type": "STRING"} for n in ("kind", "place")],
         {"name": "extra", "type": "RECORD", "fields": [{"name": "other", "type": "INTEGER"}]}]
    )
    assert files.unknown_fields(spark, str(path), nested) == ["extra.deep"]
    with pytest.raises(FAILURES):
        files.scan_jsonl(spark, str(path), T.StructType.fromDDL("kind int"), ignore_unknown=True).collect()


def test_unknown_fields_at_any_depth(spark, tmp_path):
    """Known fields of any shape pass in one scan of the files; a single unknown one fails the job, whatever is selected."""

    schema = T.StructType.fromDDL("a int, s struct<x:int,y:struct<z:string>>, l array<struct<k:string,n:int>>, t string, m map<string,int>")
    good = ['{"a":1,"s":{"x":2,"y":{"z":"q"}},"l":[{"k":"v"},{"n":3}],"t":{"any":1},"m":{"p":1}}', "", '{"s":null,"l":[],"m":{}}', '{"l":[null]}']
    (tmp_path / "good.jsonl").write_text("\n".join(good))
    got = files.scan_jsonl(spark, str(tmp_path / "good.jsonl"), schema)
    assert got.schema == schema and got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert [tuple(r) for r in got.select("a", "s.y.z", "t", F.size("l")).collect()] == [(1, "q", '{"any":1}', 2), (None, None, None, 0), (None, None, None, 1)]
    bad = {'{"b":null}': "b", '{"s":{"w":1}}': "s.w", '{"s":{"y":{"q":1}}}': "s.y.q", '{"l":[{"k":"v"},{"o":1}]}': "l.o"}
    for number, (line, path) in enumerate(bad.items()):
        file = tmp_path / f"bad{number}.jsonl"
        file.write_text("\n".join([*good, line]))
        with pytest.raises(FAILURES, match=f"schema: {path}"):
            files.scan_jsonl(spark, str(file), schema).select("a").collect()
        assert files.unknown_fields(spark, str(file), schema) == [path]


def test_xml(spark, tmp_path):
    trip = "<trip><ship>Petrel</ship><left>04:10</left><port>Vardø</port></trip>"
    schema = "ship string, `left` string, port string"
    df = spark.createDataFrame([(trip,)], "x string")
    assert tuple(files.scan_xml(df, "x", schema).first()["record"]) == ("Petrel", "04:10", "Vardø")
    (tmp_path / "a.xml").write_text(f"<log>{trip}{trip}</log>")
    assert files.scan_xml_files(spark, str(tmp_path / "a.xml"), "trip", schema).count() == 2


def test_list_files(spark, tmp_path):
    (tmp_path / "ice" / "1998").mkdir(parents=True)
    for key, month in (("ice/1998/cores.tsv", 3), ("ice/notes.tsv", 5), ("index.md", 9)):
        (tmp_path / key).write_text("x")
        stamp = dt.datetime(1998, month, 12, tzinfo=dt.timezone.utc).timestamp()
        os.utime(tmp_path / key, (stamp, stamp))

    def keys(**how):
        return sorted(r["key"] for r in files.list_files(spark, str(tmp_path), **how).collect())

    assert keys() == ["ice/1998/cores.tsv", "ice/notes.tsv", "index.md"]
    assert keys(prefix="ice/1") == ["ice/1998/cores.tsv"]
    assert keys(glob="ice/*.tsv") == ["ice/notes.tsv"]
    assert keys(glob="**.tsv") == ["ice/1998/cores.tsv", "ice/notes.tsv"]
    assert keys(glob="*d*") == ["index.md"]
    assert keys(regex="notes|cores") == ["ice/1998/cores.tsv", "ice/notes.tsv"]
    assert keys(regex="otes") == []
    assert keys(modified_since=dt.datetime(1998, 4, 1)) == ["ice/notes.tsv", "index.md"]
    assert keys(modified_before=dt.datetime(1998, 4, 1)) == ["ice/1998/cores.tsv"]
    assert keys(modified_since=dt.datetime(1999, 1, 1)) == []


@pytest.mark.parametrize("kind", ["csv", "csv.gz", "jsonl", "jsonl.gz"])
def test_export_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'a "quoted", text', None), (2, None, dt.datetime(2024, 1, 1, 0, 0, 0, 123456))], "i int, s string, t timestamp")
    path = str(tmp_path / "out")
    export.export_table(df, path, kind)
    found = [f for f in os.listdir(path) if f.startswith("part-")]
    assert all(f.endswith(".gz") == kind.endswith(".gz") for f in found)
    back = files.scan_csv(spark, path, df.schema, skip_rows=1) if kind.startswith("csv") else files.scan_jsonl(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        export.export_table(df, path, "parquet")


@pytest.fixture(scope="module")
def uuid_rows(spark):
    rows = [(i, str(uuid.uuid4()), str(uuid.uuid4())) for i in range(1000)]
    return spark.createDataFrame(rows, "i int, name string, country string")


def parts_of(path, opener):
    out = []
    for folder in sorted(p for p in os.listdir(path) if p.startswith("part_file=")):
        names = [n for n in os.listdir(os.path.join(path, folder)) if n.startswith("part-")]
        assert len(names) == 1
        with opener(os.path.join(path, folder, names[0]), "rt") as f:
            out.append((folder, f.read(), os.path.getsize(os.path.join(path, folder, names[0]))))
    return out


def test_plain_parts(spark, tmp_path, uuid_rows):
    path = str(tmp_path / "parts")
    export.export_parts(uuid_rows.repartition(8), path, ["i"], stem="rows", max_bytes=2048)
    parts = parts_of(path, open)
    wanted = [json.dumps({"i": r[0], "name": r[1], "country": r[2]}, separators=(",", ":")) for r in sorted(uuid_rows.collect())]
    assert "".join(p[1] for p in parts).splitlines() == wanted
    longest = max(map(len, wanted)) + 1
    assert all(0 < len(p[1]) < 2048 + longest for p in parts)
    assert [p[0] for p in parts][:2] == ["part_file=rows000000000000.jsonl", "part_file=rows000000000001.jsonl"]
    assert len(parts) == -(-sum(len(w) + 1 for w in wanted) // 2048)


def test_gz_parts(spark, tmp_path):
    rows = [(i, uuid.uuid4().hex * 8) for i in range(4000)]
    df = spark.createDataFrame(rows, "i int, line string")
    path = str(tmp_path / "parts")
    export.export_parts(df, path, ["i"], line="line", max_bytes=64 * 1024, compress=True)
    parts = parts_of(path, gzip.open)
    assert "".join(p[1] for p in parts).splitlines() == [r[1] for r in rows]
    assert len(parts) > 1 and all(p[2] < 64 * 1024 + 64 * 1024 for p in parts)


def test_row_positions(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"), (F.col("id") % 11).alias("size")).repartition(7)
    assert [r["row_index"] for r in with_row_index(df, ["k"]).orderBy("k").collect()] == list(range(5000))
    rows = with_sum_before(df, running_size(F.col("size")), ["k"]).orderBy("k").collect()
    total = 0
    for row in rows:
        assert row["size_before"] == total
        total += row["size"]
    assert with_row_index(df.limit(0), ["k"]).count() == 0


def test_manifest(spark, tmp_path):
    keys = ["plain", 'with "quote"', "with,comma", "naïve"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    path = tmp_path / "m"
    export.transfer_manifest(df, "key", str(path))
    (name,) = [n for n in os.listdir(path) if n.startswith("part-")]
    with open(path / name, newline="") as f:
        assert sorted(r[0] for r in csv.reader(f)) == sorted(keys)
    assert export.manifest_check(df, "key").first()["n_bytes"] == os.path.getsize(path / name)
    bad = df.select(F.unhex(F.lit("ff")).cast("binary").alias("b")).select(F.expr("cast(b as string)").alias("key"))
    with pytest.raises(ValueError, match="UTF-8"):
        export.transfer_manifest(bad, "key", str(tmp_path / "bad"))
    export.MANIFEST_BYTES, limit = 10, export.MANIFEST_BYTES
    try:
        with pytest.raises(ValueError, match="bytes"):
            export.transfer_manifest(df, "key", str(tmp_path / "big"))
    finally:
        export.MANIFEST_BYTES = limit
