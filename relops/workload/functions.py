"""Record, date, name and digest functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.functions import dates, hashing, names, nested, text
from relops.staging import chunk_rows as chunked
from relops.workload.base import query, table


@query("SELECT event_id, '2024-02-01' AS snapshot_date, '2024-02-01T06:00:00' AS hour_stamp, "
       "strftime(ts, '%Y-%m-%d') AS day_stamp FROM events")
def add_partition_date(spark: SparkSession, sf: str) -> DataFrame:
    at = dt.datetime(2024, 2, 1, 6)
    stamped = nested.add_partition_date(table(spark, sf, "events").select("event_id", "ts"), at)
    stamped = nested.add_partition_date(stamped, at, "HOUR", "hour_stamp")
    return nested.add_partition_date(stamped, F.col("ts"), "MONTH", "day_stamp").drop("ts")


@query(
    """
    SELECT o_orderkey AS order_key_, o_orderstatus AS "9_status", o_totalprice AS "price_été",
      '{"a_b":"' || o_orderpriority || '"}' AS tags, o_custkey AS item_sku, o_orderstatus AS twice FROM orders
    """
)
def clean_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Odd characters in columns, nested fields, arrays of structs and map keys; colliding names keep the last."""

    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("__order key!"),
        F.struct(
            F.col("o_orderstatus").alias("9-status"),
            F.col("o_totalprice").alias("éprice  été"),
        ).alias("@info"),
        F.create_map(F.lit("_a-b"), F.lit("lost"), F.lit("a b"), F.col("o_orderpriority")).alias("tags"),
        F.array(F.struct(F.col("o_custkey").alias("item.sku"))).alias("items"),
        F.col("o_orderpriority").alias("#twice"),
        F.col("o_orderstatus").alias("twice"),
    )
    cleaned = nested.clean_keys(raw)
    return cleaned.select(
        "order_key_",
        F.col("info.9_status").alias("9_status"),
        F.col("info.price_été").alias("price_été"),
        F.to_json("tags").alias("tags"),
        F.col("items")[0]["item_sku"].alias("item_sku"),
        "twice",
    )


@query(r"SELECT doc_id, regexp_replace(text, '([A-Za-z]+), ([A-Za-z]+)', '\2 and \1', 'g') AS text FROM documents")
def replace_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return text.replace_text(docs, "text", r"([A-Za-z]+), ([A-Za-z]+)", r"\2 and \1")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS missing FROM events")
def get_or_none(spark: SparkSession, sf: str) -> DataFrame:
    record = F.parse_json("props")
    return table(spark, sf, "events").select(
        "event_id",
        nested.get_or_none(record, "k", dtype="bigint").alias("k"),
        nested.get_or_none(record, "absent").alias("missing"),
    )


def ragged(events: DataFrame) -> DataFrame:
    """Records whose entry ``a`` is a list, a single value, null or absent."""

    k = F.get_json_object("props", "$.k")
    record = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"a":'), k, F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"a":['), k, F.lit(',"x"]}')))
        .when(F.col("event_type") == "error", F.lit('{"a":null}'))
        .otherwise(F.lit("{}"))
    )
    return events.select("event_id", F.parse_json(record).alias("record"))


@query(
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN '[' || k || ']' WHEN 'view' THEN '[' || k || ',"x"]'
      WHEN 'error' THEN '[null]' ELSE '[]' END AS a
    FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
    """
)
def ensure_list(spark: SparkSession, sf: str) -> DataFrame:
    return ragged(table(spark, sf, "events")).select("event_id", F.to_json(nested.ensure_list(F.col("record"), "a")).alias("a"))


@query(
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN '[' || k || ']' WHEN 'view' THEN '[' || k || ',7]'
      WHEN 'signup' THEN '[]' END AS refs
    FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
    """
)
def ensure_list_or_none(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    record = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"refs":{"@count":"1","ref":'), k, F.lit("}}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"refs":{"@count":"2","ref":['), k, F.lit(",7]}}")))
        .when(F.col("event_type") == "error", F.lit('{"refs":{"@count":"0","ref":1}}'))
        .when(F.col("event_type") == "signup", F.lit('{"refs":{"@count":0}}'))
        .otherwise(F.lit("{}"))
    )
    refs = nested.ensure_list_or_none(F.parse_json(record), "refs", "ref")
    return table(spark, sf, "events").select("event_id", F.to_json(refs).alias("refs"))


def zoned_text(events: DataFrame) -> DataFrame:
    """Timestamps written with five kinds of zone, some with microseconds."""

    micros = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = (
        F.when(F.col("event_type") == "click", F.concat(micros, F.lit("+0800")))
        .when(F.col("event_type") == "view", F.concat(seconds, F.lit("Z")))
        .when(F.col("event_type") == "error", F.concat(micros, F.lit("UTC+1")))
        .when(F.col("event_type") == "signup", F.concat(seconds, F.lit(" -03:30")))
        .otherwise(micros)
    )
    return events.withColumn("written", written)


_ISO_OUT = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {0} = date_trunc('second', {0}) THEN '' ELSE strftime({0}, '.%f') END"


@query(
    f"""
    SELECT event_id, {_ISO_OUT.format('u')} || '+00:00' AS utc FROM (
      SELECT event_id, CASE event_type WHEN 'click' THEN ts - INTERVAL 8 HOUR WHEN 'view' THEN date_trunc('second', ts)
        WHEN 'error' THEN ts + INTERVAL 1 HOUR WHEN 'signup' THEN date_trunc('second', ts) + INTERVAL 210 MINUTE
        ELSE ts END AS u FROM events)
    """
)
def normalise_datetime(spark: SparkSession, sf: str) -> DataFrame:
    written = zoned_text(table(spark, sf, "events"))
    return written.select("event_id", dates.normalise_datetime(F.col("written")).alias("utc"))


@query(
    f"""
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS parsed,
      CASE WHEN event_type = 'error' THEN NULL ELSE {_ISO_OUT.format('ts')} || 'Z' END AS written FROM events
    """
)
def release_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stamp = F.when(F.col("event_type") != "error", stamp)
    parsed = dates.to_release_timestamp(stamp)
    return table(spark, sf, "events").select(
        "event_id", parsed.cast("timestamp_ntz").alias("parsed"), dates.from_release_timestamp(parsed).alias("written")
    )


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS placed,
      CASE WHEN o_orderstatus = 'P' THEN 'unknown' END AS placed_raw,
      CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate + INTERVAL 1500 MILLISECOND END AS seen,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' END AS seen_raw FROM orders
    """
)
def parse_typed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Two date layouts and unreadable text at the top, timestamps inside a nested array."""

    placed = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyyMMdd"))
        .otherwise(F.lit("unknown"))
    )
    moment = F.col("o_orderdate") + F.expr("INTERVAL '1.5' SECOND")
    seen = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS 'UTC'"))
        .when(F.col("o_orderpriority") != "5-LOW", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(F.lit("n/a"))
    )
    raw = table(spark, sf, "orders").select(
        "o_orderkey", placed.alias("placed"), F.array(F.struct(seen.alias("seen"))).alias("log")
    )
    typed = nested.parse_typed_fields(raw, ["placed"], ["seen"])
    entry = F.col("log")[0]
    return typed.select(
        "o_orderkey", "placed", "placed_raw", entry["seen"].cast("timestamp_ntz").alias("seen"), entry["seen_raw"].alias("seen_raw")
    )


@query(
    """
    SELECT id AS table_id, string_split(id, '.')[1] AS catalog, string_split(id, '.')[2] AS schema,
      'orders' AS "table", CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS shard_date
    FROM (SELECT *, 'lake.' || lower(o_orderstatus) || '.orders' ||
      CASE WHEN o_orderstatus = 'F' THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END AS id FROM orders)
    """
)
def parse_table_id(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.lit("lake"), F.lower("o_orderstatus"), F.lit("orders")]
    table_id = F.when(F.col("o_orderstatus") == "F", names.make_table_id(*parts)).otherwise(
        names.make_shard_id(*parts, F.col("o_orderdate"))
    )
    ids = table(spark, sf, "orders").select(table_id.alias("table_id"))
    return ids.select("table_id", names.parse_table_id(F.col("table_id")).alias("p")).select("table_id", "p.*")


@query(
    """
    SELECT o_orderkey, 'lake.sales.orders' AS table_id,
      'lake.sales.orders' || strftime(o_orderdate, '%Y%m%d') AS shard_id FROM orders
    """
)
def make_shard_id(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.lit("lake"), F.lit("sales"), F.lit("orders")]
    return table(spark, sf, "orders").select(
        "o_orderkey",
        names.make_table_id(*parts).alias("table_id"),
        names.make_shard_id(*parts, F.col("o_orderdate")).alias("shard_id"),
    )


@query(
    """
    WITH u AS (
      SELECT 'gs://' || string_split(url, '://')[2] AS uri FROM pages
      UNION ALL SELECT 'gs://' || string_split(string_split(url, '://')[2], '/')[1] FROM pages)
    SELECT uri, string_split(substr(uri, 6), '/')[1] AS bucket,
      CASE WHEN contains(substr(uri, 6), '/') THEN substr(uri, 7 + length(string_split(substr(uri, 6), '/')[1])) END AS key
    FROM u
    """
)
def object_uri_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as an object URI, and its bucket alone."""

    rest = F.substring_index("url", "://", -1)
    pages = table(spark, sf, "pages")
    uris = pages.select(F.concat(F.lit("gs://"), rest).alias("uri")).union(
        pages.select(F.concat(F.lit("gs://"), F.substring_index(rest, "/", 1)))
    )
    return uris.select("uri", names.object_uri_parts(F.col("uri")).alias("p")).select("uri", "p.*")


@query(
    """
    SELECT page_id, 'gs://pages/' || trim(substr(url, strpos(url, '://') + 3), '/') AS uri FROM pages
    """
)
def key_from_path(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.substring_index("url", "://", -1))
    key = names.key_from_path(path, "/data/")
    return table(spark, sf, "pages").select("page_id", names.object_uri(F.lit("pages"), key).alias("uri"))


@query("SELECT page_id, string_split(string_split(url, '/')[-1], '?')[1] AS filename FROM pages")
def filename_from_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", names.filename_from_url(F.col("url")).alias("filename"))


@query(
    """
    SELECT doc_id, CASE lang WHEN 'en' THEN source || '.jsonl.gz' WHEN 'de' THEN source || '.csv'
      WHEN 'fr' THEN 'été ' || source ELSE CAST(doc_id AS VARCHAR) || '.gz' END AS filename FROM documents
    """
)
def filename_from_disposition(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted, bare and percent-encoded header names, and headers without one."""

    source = F.col("source")
    header = (
        F.when(F.col("lang") == "en", F.concat(F.lit('attachment; filename="'), source, F.lit('.jsonl.gz"')))
        .when(F.col("lang") == "de", F.concat(F.lit("attachment; size=3; filename="), source, F.lit(".csv")))
        .when(F.col("lang") == "fr", F.concat(F.lit("attachment; filename*=UTF-8''%C3%A9t%C3%A9%20"), source))
        .when(F.col("lang") == "es", F.lit("inline"))
    )
    url = F.concat(F.lit("https://host/files/"), F.col("doc_id").cast("string"), F.lit(".gz?sig=1"))
    return table(spark, sf, "documents").select("doc_id", names.filename_from_disposition(header, url).alias("filename"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, length(text) > 0 AS has_sha512 FROM documents")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        hashing.content_digest(body).alias("md5"),
        hashing.content_digest(body, "sha256").alias("sha256"),
        (F.length(hashing.content_digest(body, "sha512")) == 128).alias("has_sha512"),
    )


@query(
    """
    WITH RECURSIVE
    bytes AS (SELECT list_transform(range(256), lambda i: CAST(i AS BIGINT)) AS t, 0 AS round
      UNION ALL SELECT list_transform(t, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END), round + 1
      FROM bytes WHERE round < 8),
    crc_table AS (SELECT t FROM bytes WHERE round = 8),
    pairs AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS b
      FROM documents)
    SELECT doc_id, to_base64(unhex(printf('%08X', xor(
      list_reduce(b, lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)))) AS crc32c
    FROM pairs, crc_table
    """
)
def crc32c_base64(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", hashing.crc32c_base64(F.col("text")).alias("crc32c"))


@query("SELECT doc_id, to_base64(unhex(md5(text))) AS digest FROM documents")
def hex_to_base64(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", hashing.hex_to_base64(F.md5("text")).alias("digest"))


@query("SELECT doc_id, text FROM documents")
def decode_base64url(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as URL-safe base64 payloads, decoded back; an empty text has no payload and stays."""

    payload = F.replace(F.replace(F.base64(F.col("text").cast("binary")), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    text = F.when(F.length("text") == 0, F.col("text")).otherwise(hashing.decode_base64url(payload).cast("string"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query(
    """
    WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
    SELECT doc_id, CAST(len(c) AS BIGINT) AS n_chunks, CAST(len(c[-1]) AS BIGINT) AS last_size,
      array_to_string(list_transform(c, lambda x: array_to_string(x, ' ')), '|') AS joined
    FROM (SELECT doc_id, list_transform(range(0, len(w), 8), lambda i: w[i + 1 : i + 8]) AS c FROM w)
    """
)
def chunk_list(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("text", " ")
    chunks = F.col("chunks")
    return (
        table(spark, sf, "documents")
        .select("doc_id", nested.chunk_list(words, 8).alias("chunks"))
        .select(
            "doc_id",
            F.size(chunks).cast("bigint").alias("n_chunks"),
            F.size(F.element_at(chunks, -1)).cast("bigint").alias("last_size"),
            F.array_join(F.transform(chunks, lambda c: F.array_join(c, " ")), "|").alias("joined"),
        )
    )


@query(
    """
    SELECT conv_id, turn, array_to_string(list_transform(
        list_filter(string_split(text, '. '), lambda s: role <> 'system' AND contains(s, ' the ')), lambda s: md5(s)), ',') AS ids
    FROM conversations
    """
)
def attachment_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences as message parts, some with a file name; system messages have no parts at all."""

    part = F.transform(
        F.split("text", r"\. "),
        lambda s: F.struct(
            F.when(s.contains(" the "), F.lit("part.txt")).otherwise(F.lit("")).alias("filename"),
            F.struct(F.md5(s).alias("attachmentId")).alias("body"),
        ),
    )
    messages = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", part).alias("parts")
    )
    return messages.select("conv_id", "turn", F.array_join(nested.attachment_ids(F.col("parts")), ",").alias("ids"))


@query(
    """
    WITH c AS (SELECT o_custkey, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1),
    m AS (SELECT o_custkey, s, e, unnest(generate_series(0, 400)) AS i FROM c),
    b AS (SELECT o_custkey, e, s + to_months(CAST(i AS INTEGER)) AS b FROM m)
    SELECT o_custkey, b AS section_start,
      least(e, date_trunc('day', b + INTERVAL 1 MONTH) - INTERVAL 1 MICROSECOND) AS section_end FROM b WHERE b < e
    """
)
def monthly_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch sections from each customer's first to last order."""

    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e")
    )
    return spans.select("o_custkey", F.inline(dates.monthly_sections(F.col("s"), F.col("e"))))


@query(
    """
    WITH c AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1),
    m AS (SELECT o_custkey, s, e, unnest(generate_series(0, 400)) AS i FROM c),
    b AS (SELECT o_custkey, e, CAST(s + to_months(CAST(i AS INTEGER)) AS DATE) AS b FROM m)
    SELECT o_custkey, b AS section_start, least(e, CAST(b + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE)) AS section_end
    FROM b WHERE b < e
    """
)
def monthly_sections_dates(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e")
    )
    return spans.select("o_custkey", F.inline(dates.monthly_sections(F.col("s"), F.col("e"), as_dates=True)))


@query("SELECT event_id, user_id AS _row, (row_number() OVER (ORDER BY event_id) - 1) // 7 AS chunk FROM events")
def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events in sevens by their id, with a column named like a helper."""

    return chunked(table(spark, sf, "events").select("event_id", F.col("user_id").alias("_row")), 7, ["event_id"])
