"""Upsert, delete, change files, comparisons, as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.operators.asof import latest_run_as_of
from relops.operators.compare import key_set_diff, table_diff, table_integrity, transfer_diff, verify_transfers
from relops.operators.incremental import delete_by_keys, merge_changefiles, upsert
from relops.workload.base import query, table

NEW_KEY = 1_000_000_000


def order_updates(orders: DataFrame) -> DataFrame:
    """Pending orders at twice the price, and urgent orders once more under new keys."""

    changed = orders.filter(F.col("o_orderstatus") == "P").withColumns(
        {"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("U")}
    )
    added = orders.filter(F.col("o_orderpriority") == "1-URGENT").withColumn(
        "o_orderkey", F.col("o_orderkey") + NEW_KEY
    )
    return changed.unionByName(added)


ORDER_UPDATES = f"""
  SELECT o_orderkey, o_custkey, 'U' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderstatus = 'P'
  UNION ALL
  SELECT o_orderkey + {NEW_KEY}, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderpriority = '1-URGENT'
"""


@query(
    f"""
    WITH u AS ({ORDER_UPDATES})
    SELECT * FROM u
    UNION ALL
    SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.o_orderkey = o.o_orderkey)
    """
)
def upsert_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return upsert(orders, order_updates(orders), "o_orderkey")


@query(
    """
    WITH m AS (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey AS nation, c_acctbal AS amount FROM customer),
    u AS (
      SELECT nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey AS nation, max(c_acctbal) + 1 AS amount
      FROM customer WHERE c_nationkey < 10 GROUP BY ALL)
    SELECT m.segment, m.nation, CASE WHEN u.nation IS NULL THEN m.amount ELSE u.amount END AS amount
    FROM m LEFT JOIN u ON m.segment = u.segment AND m.nation = u.nation
    UNION ALL
    SELECT * FROM u WHERE segment IS NULL
    """
)
def upsert_null_and_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Each update hits many main rows; null keys match nothing and their updates are inserted."""

    main = table(spark, sf, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("amount"),
    )
    updates = (
        main.filter(F.col("nation") < 10).groupBy("segment", "nation").agg((F.max("amount") + 1).alias("amount"))
    )
    return upsert(main, updates, ["segment", "nation"])


@query(
    """
    WITH u AS (
      SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_quantity) + 100 AS l_quantity
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT l.l_orderkey, l.l_linenumber,
      CASE WHEN u.l_orderkey IS NULL THEN l.l_partkey ELSE u.l_partkey END AS l_partkey,
      CASE WHEN u.l_orderkey IS NULL THEN l.l_quantity ELSE u.l_quantity END AS l_quantity
    FROM lineitem l LEFT JOIN u ON l.l_orderkey = u.l_orderkey AND l.l_linenumber = u.l_linenumber
    """
)
def upsert_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    """Two key columns that repeat in the main table."""

    main = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    returned = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    updates = returned.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("l_partkey"), (F.max("l_quantity") + 100).alias("l_quantity")
    )
    return upsert(main, updates, ["l_orderkey", "l_linenumber"])


@query(
    """
    SELECT * FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'P' AND o.o_custkey = c.c_custkey)
    """
)
def delete_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a pending order: the delete set repeats its keys."""

    pending = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    return delete_by_keys(table(spark, sf, "customer"), pending, "c_custkey", "o_custkey")


@query(
    """
    SELECT * FROM customer c WHERE NOT EXISTS (
      SELECT 1 FROM orders o WHERE o.o_orderpriority = '5-LOW'
        AND 'Customer#' || CAST(c.c_custkey AS VARCHAR) = 'Customer#' || CAST(o.o_custkey AS VARCHAR))
    """
)
def delete_by_prefixed_key(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    low = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "5-LOW")
    named = low.select(F.concat(F.lit("Customer#"), F.col("o_custkey")).alias("name"))
    keyed = customers.withColumn("_key", F.col("c_custkey").cast("string"))
    return delete_by_keys(keyed, named, "_key", "name", main_prefix="Customer#").drop("_key")


@query(
    """
    SELECT * FROM lineitem l WHERE NOT EXISTS (
      SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'A'
        AND d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber)
    """
)
def delete_multi_key(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return delete_by_keys(lines, lines.filter(F.col("l_returnflag") == "A"), ["l_orderkey", "l_linenumber"])


@query(
    """
    WITH c AS (SELECT event_id, user_id, event_type, value, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS seq FROM events)
    SELECT * FROM c QUALIFY seq = max(seq) OVER (PARTITION BY user_id)
    """
)
def merge_changefiles_events(spark: SparkSession, sf: str) -> DataFrame:
    """One change file per day; a user keeps all rows of the last day they appear in."""

    changes = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyyMMdd").cast("bigint").alias("seq")
    )
    return merge_changefiles(changes, "user_id", "seq")


@query(
    """
    WITH c AS (
      SELECT event_id, nullif(event_type, 'error') AS key, CAST(strftime(ts, '%Y%m%d%H') AS BIGINT) AS seq FROM events)
    SELECT * FROM c QUALIFY seq = max(seq) OVER (PARTITION BY key)
    """
)
def merge_changefiles_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """A handful of keys, one of them null, hold all rows."""

    changes = table(spark, sf, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("key"),
        F.date_format("ts", "yyyyMMddHH").cast("bigint").alias("seq"),
    )
    return merge_changefiles(changes, "key", "seq")


def changed_labels(labels: DataFrame) -> DataFrame:
    """Toxic rows dropped, low quality rows flipped, toxic rows back under new ids."""

    kept = labels.filter(F.col("toxic") == 0).withColumn(
        "toxic", F.when(F.col("quality") == 0, 1).otherwise(F.col("toxic"))
    )
    moved = labels.filter(F.col("toxic") == 1).withColumn("doc_id", F.col("doc_id") + NEW_KEY)
    return kept.unionByName(moved)


CHANGED_LABELS = f"""
  SELECT doc_id, quality, CASE WHEN quality = 0 THEN 1 ELSE toxic END AS toxic FROM labels WHERE toxic = 0
  UNION ALL SELECT doc_id + {NEW_KEY}, quality, toxic FROM labels WHERE toxic = 1
"""


@query(
    f"""
    WITH a AS ({CHANGED_LABELS}), j AS (
      SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, e.doc_id AS e_id, a.doc_id AS a_id,
        e.quality AS eq, a.quality AS aq, e.toxic AS e_toxic, a.toxic AS a_toxic
      FROM labels e FULL JOIN a ON e.doc_id = a.doc_id)
    SELECT doc_id, 'only_expected' AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual
    FROM j WHERE a_id IS NULL
    UNION ALL SELECT doc_id, 'only_actual', NULL, NULL, NULL FROM j WHERE e_id IS NULL
    UNION ALL SELECT doc_id, 'value', 'quality', CAST(eq AS VARCHAR), CAST(aq AS VARCHAR) FROM j
    WHERE e_id IS NOT NULL AND a_id IS NOT NULL AND eq IS DISTINCT FROM aq
    UNION ALL SELECT doc_id, 'value', 'toxic', CAST(e_toxic AS VARCHAR), CAST(a_toxic AS VARCHAR) FROM j
    WHERE e_id IS NOT NULL AND a_id IS NOT NULL AND e_toxic IS DISTINCT FROM a_toxic
    """
)
def table_diff_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return table_diff(labels, changed_labels(labels), "doc_id")


@query(
    """
    WITH e AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
    a AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
    j AS (SELECT coalesce(e.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(e.l_linenumber, a.l_linenumber) AS l_linenumber,
      coalesce(e.n, 0) AS ne, coalesce(a.n, 0) AS na
      FROM e FULL JOIN a ON e.l_orderkey = a.l_orderkey AND e.l_linenumber = a.l_linenumber)
    SELECT l_orderkey, l_linenumber, 'only_expected' AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual
    FROM j WHERE na = 0
    UNION ALL SELECT l_orderkey, l_linenumber, 'only_actual', NULL, NULL, NULL FROM j WHERE ne = 0
    UNION ALL SELECT l_orderkey, l_linenumber, 'duplicate_key', NULL, CAST(ne AS VARCHAR), CAST(na AS VARCHAR) FROM j
    WHERE ne > 1 OR na > 1
    UNION ALL SELECT j.l_orderkey, j.l_linenumber, 'value', f.field,
      CASE f.field WHEN 'l_returnflag' THEN x.l_returnflag ELSE x.l_linestatus END, CASE f.field WHEN 'l_returnflag' THEN y.l_returnflag ELSE y.l_linestatus END
    FROM j JOIN lineitem x ON x.l_orderkey = j.l_orderkey AND x.l_linenumber = j.l_linenumber AND x.l_returnflag <> 'N'
    JOIN lineitem y ON y.l_orderkey = j.l_orderkey AND y.l_linenumber = j.l_linenumber AND y.l_linestatus = 'O'
    JOIN (SELECT unnest(['l_returnflag', 'l_linestatus']) AS field) f
      ON CASE f.field WHEN 'l_returnflag' THEN x.l_returnflag <> y.l_returnflag ELSE x.l_linestatus <> y.l_linestatus END
    WHERE ne = 1 AND na = 1
    """
)
def table_diff_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Two slices of one table under a key that repeats."""

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    expected = lines.filter(F.col("l_returnflag") != "N")
    actual = lines.filter(F.col("l_linestatus") == "O")
    return table_diff(expected, actual, ["l_orderkey", "l_linenumber"])


@query(
    f"""
    WITH a AS ({CHANGED_LABELS})
    SELECT coalesce(e.doc_id, a.doc_id) AS doc_id,
      CASE WHEN a.doc_id IS NULL THEN 'left' WHEN e.doc_id IS NULL THEN 'right' ELSE 'both' END AS side
    FROM labels e FULL JOIN a ON e.doc_id = a.doc_id
    """
)
def key_set_diff_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return key_set_diff(labels, changed_labels(labels), "doc_id")


SOURCE_LISTING = """
  SELECT CASE WHEN source = 'src1' THEN NULL ELSE source || '/' || CAST(doc_id AS VARCHAR) END AS key,
    md5(text) AS checksum, CASE WHEN lang = 'de' THEN NULL ELSE 'md5' END AS algorithm FROM documents
"""
TARGET_LISTING = """
  SELECT source || '/' || CAST(doc_id AS VARCHAR) AS key,
    CASE WHEN lang = 'fr' THEN 'stale' ELSE md5(text) END AS checksum FROM documents WHERE source <> 'src0'
"""


def listings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as objects of a source and of a target that lacks some, has stale ones and no key for others."""

    docs = table(spark, sf, "documents")
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    source = docs.select(
        F.when(F.col("source") != "src1", key).alias("key"),
        F.md5("text").alias("checksum"),
        F.when(F.col("lang") != "de", "md5").alias("algorithm"),
    )
    target = docs.filter(F.col("source") != "src0").select(
        key.alias("key"), F.when(F.col("lang") == "fr", "stale").otherwise(F.md5("text")).alias("checksum")
    )
    return source, target


@query(
    f"""
    WITH s AS ({SOURCE_LISTING}), t AS ({TARGET_LISTING})
    SELECT s.key, s.checksum, s.algorithm, t.checksum AS target_checksum,
      CASE WHEN t.key IS NULL THEN 'new' WHEN s.algorithm IS NULL THEN 'unverified'
        WHEN s.checksum = t.checksum THEN 'skip' ELSE 'changed' END AS status
    FROM s LEFT JOIN t ON s.key = t.key
    """
)
def transfer_diff_documents(spark: SparkSession, sf: str) -> DataFrame:
    source, target = listings(spark, sf)
    return transfer_diff(source, target, algorithm="algorithm")


@query(
    f"""
    WITH s AS ({SOURCE_LISTING}), t AS ({TARGET_LISTING})
    SELECT s.key, CASE WHEN t.key IS NULL OR s.algorithm IS NULL THEN 'unchecked' WHEN s.checksum = t.checksum THEN 'ok'
      WHEN substr(s.checksum, 1, 1) < '8' THEN 'error' ELSE 'retry' END AS verdict
    FROM s LEFT JOIN t ON s.key = t.key
    """
)
def verify_transfers_documents(spark: SparkSession, sf: str) -> DataFrame:
    source, target = listings(spark, sf)
    manifest = source.select(
        "key",
        F.when(F.col("algorithm").isNotNull(), F.col("checksum")).alias("checksum"),
        (F.substring("checksum", 1, 1) < "8").alias("retried"),
    )
    return verify_transfers(manifest, target).select("key", "verdict")


RUNS = """
  SELECT user_id AS dag_id, ts AS logical_date, ts + to_hours(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS data_interval_end
  FROM events
"""


@query(
    f"""
    WITH runs AS ({RUNS})
    SELECT r.event_id, r.user_id AS dag_id, r.ts AS data_interval_end, max(l.logical_date) AS latest_run
    FROM events r LEFT JOIN runs l ON l.dag_id = r.user_id AND l.data_interval_end <= r.ts
    GROUP BY ALL
    """
)
def latest_run_as_of_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event asks for the newest run of its pipeline that had ended; runs end hours after they start."""

    events = table(spark, sf, "events")
    hours = F.get_json_object("props", "$.k").cast("int")
    runs = events.select(
        F.col("user_id").alias("dag_id"),
        F.col("ts").alias("logical_date"),
        (F.col("ts") + F.make_dt_interval(hours=hours)).alias("data_interval_end"),
    )
    requests = events.select("event_id", F.col("user_id").alias("dag_id"), F.col("ts").alias("data_interval_end"))
    return latest_run_as_of(requests, runs)


@query(
    """
    SELECT 'orders' AS table_name, count(*) AS n_rows, count(*) = 15000 AS as_expected FROM orders
    UNION ALL SELECT 'lineitem', count(*), NULL FROM lineitem
    UNION ALL SELECT 'events', count(*), count(*) = 1 FROM events
    """
)
def table_integrity_counts(spark: SparkSession, sf: str) -> DataFrame:
    tables = {name: table(spark, sf, name) for name in ("orders", "lineitem", "events")}
    return table_integrity(tables, {"orders": 15000, "events": 1})
