import base64
import datetime as dt
import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relops.functions import dates, hashing, names, nested, text
from relops.functions.hashing import _crc32c_rows
from relops.workload import ORACLES, QUERIES


def one(spark, column, **values):
    """The value of a column expression over one row of string literals."""

    df = spark.createDataFrame([tuple(values.values()) or ("",)], list(values) or ["_"]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


# Own vectors: summer and winter days of several years, offsets west and east, with and without minutes and fractions.
TIMES = [
    ("1998-07-14T23:45:10.5+0930", "1998-07-14T14:15:10.500000+00:00"),
    ("19990309", "1999-03-09T00:00:00+00:00"),
    ("2003-02-28 22:30:00-0230", "2003-03-01T01:00:00+00:00"),
    ("2011-06-30T06:05:04Z", "2011-06-30T06:05:04+00:00"),
    ("2007-10-05 17:20:00", "2007-10-05T17:20:00+00:00"),
    ("Sat, 29 Feb 2020 18:09:07 GMT", "2020-02-29T18:09:07+00:00"),
    ("2016-12-31 23:00:00UTC+3", "2017-01-01T02:00:00+00:00"),
    ("Oct 21, 2015", "2015-10-21T00:00:00+00:00"),
    ("2018-04-02 03:15 +05:45", "2018-04-01T21:30:00+00:00"),
]


def test_normalise_datetime(spark):
    df = spark.createDataFrame(TIMES, "t string, want string").withColumn("got", dates.normalise_datetime(F.col("t")))
    assert [(r["t"], r["got"]) for r in df.collect()] == TIMES
    assert one(spark, dates.normalise_datetime(F.lit("soon"), strict=False)) is None
    with pytest.raises(PySparkException):
        one(spark, dates.normalise_datetime(F.lit("soon")))


def sections(spark, start, end, as_dates=False):
    value = one(spark, dates.monthly_sections(F.lit(start), F.lit(end), as_dates))
    return [tuple(s) for s in value]


def test_monthly_sections(spark):
    d, t = dt.date, dt.datetime
    assert sections(spark, d(2021, 1, 1), d(2021, 2, 1), True) == [(d(2021, 1, 1), d(2021, 1, 31))]
    assert sections(spark, t(2021, 1, 1), t(2021, 3, 1)) == [
        (t(2021, 1, 1), t(2021, 1, 31, 23, 59, 59, 999999)),
        (t(2021, 2, 1), t(2021, 2, 28, 23, 59, 59, 999999)),
    ]
    assert sections(spark, t(2021, 1, 7), t(2021, 2, 7)) == [(t(2021, 1, 7), t(2021, 2, 6, 23, 59, 59, 999999))]
    assert sections(spark, d(2021, 2, 1), d(2021, 2, 1), True) == []
    # Counted from the first start: a month's last day comes back after February.
    assert [s for s, _ in sections(spark, d(2021, 1, 31), d(2021, 4, 1), True)] == [
        d(2021, 1, 31),
        d(2021, 2, 28),
        d(2021, 3, 31),
    ]


def test_partition_stamp(spark):
    at = dt.datetime(2020, 1, 1)
    df = spark.range(2)
    assert {r["snapshot_date"] for r in nested.add_partition_date(df, at).collect()} == {"2020-01-01"}
    assert nested.add_partition_date(df, at, "HOUR", "d").first()["d"] == "2020-01-01T00:00:00"
    assert nested.add_partition_date(df, at, "MONTH", "d").first()["d"] == "2020-01-01"


def test_release_timestamps(spark):
    assert one(spark, dates.from_release_timestamp(F.lit("2024-01-01T00:00:00Z").cast("timestamp"))) == "2024-01-01T00:00:00Z"
    assert one(spark, dates.to_release_timestamp(F.lit(None).cast("string"))) is None
    with pytest.raises(PySparkException):
        one(spark, dates.to_release_timestamp(F.lit("x")))


def test_typed_fields(spark):
    df = spark.createDataFrame(
        [("2009-11-30", "19870214", "2013-05-17 08:41:09.250000 UTC", "1996-08-23 21:02:00", "undated")],
        "born string, hired string, seen string, left string, paid string",
    )
    row = nested.parse_typed_fields(df, ["born", "hired", "paid"], ["seen", "left"], ["yyyy-MM-dd"]).first()
    assert (row["born"], row["hired"]) == (dt.date(2009, 11, 30), dt.date(1987, 2, 14))
    assert row["seen"] == dt.datetime(2013, 5, 17, 8, 41, 9, 250000)
    assert row["left"] == dt.datetime(1996, 8, 23, 21, 2)
    assert (row["paid"], row["paid_raw"], row["born_raw"]) == (None, "undated", None)


def test_table_ids(spark):
    def parts(table_id):
        return tuple(one(spark, names.parse_table_id(F.lit(table_id))))

    assert parts("p.d.table20190501") == ("p", "d", "table", dt.date(2019, 5, 1))
    assert parts("p.d.table") == ("p", "d", "table", None)
    for bad in ("p.d", "p.d.t.x", "p.d.table20191301"):
        with pytest.raises(PySparkException):
            parts(bad)
    assert one(spark, names.parse_table_id(F.lit(None).cast("string"))) is None


def test_uris_and_keys(spark):
    def parts(uri):
        return tuple(one(spark, names.object_uri_parts(F.lit(uri))))

    assert parts("gs://bucket/a/b.txt") == ("bucket", "a/b.txt")
    assert parts("gs://bucket") == ("bucket", None)
    assert parts("gs://bucket/") == ("bucket", "")
    with pytest.raises(PySparkException):
        parts("s3://bucket/a")
    for path in ("/srv/lake/2019/q3/orders.csv", "/srv/lake/2019/q3/orders.csv/"):
        assert one(spark, names.key_from_path(F.lit(path), "/srv/lake/")) == "2019/q3/orders.csv"
    with pytest.raises(PySparkException):
        one(spark, names.key_from_path(F.lit("/mnt/2019/orders.csv"), "/srv/lake/"))


@pytest.mark.parametrize(
    "header, url, want",
    [
        (None, "https://example.org/dump/orders-q3.zip", "orders-q3.zip"),
        (None, "https://example.org/dump/orders-q3.zip?part=2&x=y", "orders-q3.zip"),
        ('attachment; filename="Quarterly figures (final).xlsx"', "http://x", "Quarterly figures (final).xlsx"),
        ("attachment; filename=plain.csv", "http://x", "plain.csv"),
        ("attachment; filename*=UTF-8''a%20b%2Bc.csv", "http://x", "a b+c.csv"),
        ('attachment; filename=""', "http://x/y.z", "y.z"),
        ("inline", "http://x/y.z", "y.z"),
    ],
)
def test_file_names(spark, header, url, want):
    assert one(spark, names.filename_from_disposition(F.lit(header).cast("string"), F.lit(url))) == want


def test_digests(spark):
    for kind in ("md5", "sha256", "sha512"):
        assert one(spark, hashing.content_digest(F.lit("hello"), kind)) == hashlib.new(kind, b"hello").hexdigest()
    with pytest.raises(ValueError):
        hashing.content_digest(F.lit("x"), "crc")
    assert one(spark, hashing.crc32c_base64(F.lit("hello world"))) == "yZRlqg=="
    assert one(spark, hashing.hex_to_base64(F.lit("c99465aa"))) == "yZRlqg=="
    assert one(spark, hashing.crc32c_base64(F.lit(None).cast("string"))) is None


def plain_crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=1600), min_size=1, max_size=6))
def test_crc32c_of_any_bytes(values):
    assert _crc32c_rows(values).tolist() == [plain_crc32c(v) for v in values]


def test_base64url(spark):
    data = bytes(range(256))
    payload = base64.urlsafe_b64encode(data).decode()
    assert bytes(one(spark, hashing.decode_base64url(F.lit(payload)))) == data
    with pytest.raises(PySparkException):
        one(spark, hashing.decode_base64url(F.lit("")))


def test_decode_base64url_query_with_empty_texts(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "a??>>~~"), (None, "é😀\n\u0000/+-_"), (5, ""), (6, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["decode_base64url"](spark, str(tmp_path))
    sql = ORACLES["decode_base64url"]
    want = duckdb.sql(sql.replace("documents", f"read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) == sorted(rows, key=str)


def test_file_digests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"hello world")
    row = hashing.file_digests(spark, str(tmp_path)).first()
    assert (row["length"], row["digest"]) == (11, hashlib.md5(b"hello world").hexdigest())


@pytest.mark.parametrize("key, want", [("_id", "id"), ("@x-y", "x_y"), ("a b  c", "a_b_c"), ("éa", "a"), ("aé", "aé"), ("9z", "9z")])
def test_clean_key(spark, key, want):
    assert nested.clean_key(key) == want
    assert one(spark, nested.clean_key_column(F.lit(key))) == want


def test_clean_keys_deep(spark):
    df = spark.createDataFrame(
        [(1, [{"b-b": (2, None)}], {"m-n": [3]})],
        "`-a` int, `#l` array<struct<`b-b`: struct<`c c`: int, `_d`: int>>>, m map<string, array<int>>",
    )
    cleaned = nested.clean_keys(df)
    assert cleaned.schema.simpleString() == "struct<a:int,l:array<struct<b_b:struct<c_c:int,d:int>>>,m:map<string,array<int>>>"
    assert cleaned.first()["m"] == {"m_n": [3]}
    assert nested.clean_keys(df, str.upper).columns == ["-A", "#L", "M"]


def variant(spark, json, fn):
    return one(spark, F.to_json(fn(F.parse_json(F.lit(json)))))


def test_lists_of_records(spark):
    def listed(json):
        return variant(spark, json, lambda v: nested.ensure_list(v, "a"))

    assert [listed(j) for j in ("{}", '{"a":1}', '{"a":[1,"b"]}', '{"a":null}', '{"a":{"b":1}}')] == [
        "[]", "[1]", '[1,"b"]', "[null]", '[{"b":1}]',
    ]

    def counted(json):
        return variant(spark, json, lambda v: nested.ensure_list_or_none(v, "k", "s"))

    assert counted("{}") is None
    assert counted('{"k":{"@count":"0","s":[1]}}') is None
    assert counted('{"k":{"@count":"1","s":1}}') == "[1]"
    assert counted('{"k":{"@count":"1"}}') == "[]"
    with pytest.raises(PySparkException):
        counted('{"k":{"s":1}}')


def test_get_or_none(spark):
    record = F.parse_json(F.lit('{"a":"12","b":"x"}'))
    assert one(spark, nested.get_or_none(record, "a", dtype="int")) == 12
    assert one(spark, nested.get_or_none(record, "z", dtype="int")) is None
    with pytest.raises(PySparkException):
        one(spark, nested.get_or_none(record, "b", dtype="int"))


def test_chunks(spark):
    chunks = one(spark, nested.chunk_list(F.array(*[F.lit(i) for i in range(1, 10)]), 2))
    assert chunks == [[1, 2], [3, 4], [5, 6], [7, 8], [9]]
    assert one(spark, nested.chunk_list(F.array().cast("array<int>"), 2)) == []
    assert one(spark, nested.chunk_list(F.lit(None).cast("array<int>"), 2)) is None
    with pytest.raises(ValueError):
        nested.chunk_list(F.array(), 0)


def test_attachments(spark):
    part = "struct<filename: string, body: struct<attachmentId: string>>"
    df = spark.createDataFrame(
        [([("a.txt", ("1",)), ("", ("2",)), (None, ("3",)), ("b", ("4",))],), (None,)], f"parts array<{part}>"
    )
    got = df.select(nested.attachment_ids(F.col("parts")).alias("ids")).collect()
    assert [r["ids"] for r in got] == [["1", "4"], []]


def test_replacements(spark):
    assert text.java_replacement(r"\2-\g<1>$") == r"$2-$1\$"
    assert one(spark, text.replace_in(F.lit("é1 b2"), r"(\w)(\d)", r"\2\1")) == "1é 2b"


def test_gunzip(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1).write.option("compression", "gzip").text(src)
    text.gunzip_files(spark, src, dst)
    assert not list((tmp_path / "out").glob("*.gz"))
    assert sorted(r[0] for r in spark.read.text(dst).collect()) == ["a", "b"]
