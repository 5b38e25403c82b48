"""Registry, shards, schema versions, rollups, ages, guarded queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.columns import union_all
from relops.functions.names import make_shard_id
from relops.operators import registry as reg
from relops.operators.rollups import expired as expired_entries
from relops.operators.rollups import section_counts as count_sections
from relops.operators.rollups import transfer_rollup as roll_up
from relops.operators.shards import latest_tables as newest_tables
from relops.operators.shards import shard_dates as dates_of_shards
from relops.plans.guard import DEFAULT_BUDGET, BudgetExceeded, estimate_bytes, guarded_query, run_template as template
from relops.sinks.tables import save_partitioned, save_table
from relops.sources.files import list_files as files_below
from relops.sources.files import select_keys
from relops.sources.schemas import required_violations, schema_as_of as versions_as_of
from relops.sources.schemas import schema_from_fields
from relops.sources.tables import PartitionFilterRequired
from relops.session import scratch_path
from relops.workload.base import query, scratch_schema, table

REGISTRY = """
  SELECT o_orderpriority AS dag_id, o_orderstatus AS entity_id, o_orderdate AS created, o_orderkey AS release_key,
    o_totalprice AS size FROM orders
"""


def order_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as releases: priority is the pipeline, status the dataset."""

    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("dag_id"),
        F.col("o_orderstatus").alias("entity_id"),
        F.col("o_orderdate").alias("created"),
        F.col("o_orderkey").alias("release_key"),
        F.col("o_totalprice").alias("size"),
    )


@query(f"SELECT * FROM ({REGISTRY}) WHERE dag_id = '5-LOW' AND entity_id = 'F' ORDER BY created DESC, release_key DESC LIMIT 25")
def get_releases(spark: SparkSession, sf: str) -> DataFrame:
    return reg.get_releases(order_registry(spark, sf), "5-LOW", "F", "created", 25, tie_break="release_key")


@query(f"SELECT * FROM ({REGISTRY}) QUALIFY row_number() OVER (PARTITION BY dag_id, entity_id ORDER BY created DESC, release_key DESC) = 1")
def latest_release(spark: SparkSession, sf: str) -> DataFrame:
    return reg.latest_releases(order_registry(spark, sf), "created", tie_break="release_key")


@query(
    """
    WITH d AS (SELECT DISTINCT o_orderpriority AS dag_id, CAST(o_custkey AS VARCHAR) AS entity_id FROM orders),
    r AS (SELECT o_orderpriority AS dag_id, CAST(o_custkey AS VARCHAR) AS entity_id, count(*) AS n FROM orders
      WHERE o_orderstatus = 'F' GROUP BY ALL)
    SELECT dag_id, entity_id, coalesce(n, 0) AS n_releases, n IS NULL AS is_first FROM d LEFT JOIN r USING (dag_id, entity_id)
    """
)
def is_first_release(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets are (priority, customer); only finished orders count as releases."""

    releases = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("dag_id"), F.col("o_custkey").cast("string").alias("entity_id"), "o_orderstatus"
    )
    datasets = releases.select("dag_id", "entity_id").distinct()
    return reg.first_releases(releases.filter(F.col("o_orderstatus") == "F"), datasets)


def full_registry(orders: DataFrame) -> DataFrame:
    """Orders as rows with every registry column."""

    day = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.col("o_orderpriority").alias("dag_id"),
        F.col("o_orderstatus").alias("entity_id"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("dag_run_id"),
        day.alias("data_interval_start"),
        (day + F.expr("INTERVAL 1 DAY")).alias("data_interval_end"),
        F.when(F.col("o_orderstatus") == "F", day).alias("snapshot_date"),
        F.when(F.col("o_orderstatus") == "P", day).alias("partition_date"),
        F.when(F.col("o_orderstatus") == "O", day).alias("changefile_start_date"),
        F.when(F.col("o_orderstatus") == "O", day).alias("changefile_end_date"),
        F.col("o_orderkey").cast("decimal(38,9)").alias("sequence_start"),
        F.col("o_orderkey").cast("decimal(38,9)").alias("sequence_end"),
        F.parse_json(F.concat(F.lit('{"custkey":'), F.col("o_custkey").cast("string"), F.lit("}"))).alias("extra"),
        day.alias("created"),
        day.alias("modified"),
    )


@query(
    """
    WITH latest AS (SELECT o_orderpriority AS dag_id, o_orderstatus AS entity_id, max(o_orderdate) AS created,
      count(*) AS n_rows FROM orders GROUP BY ALL)
    SELECT dag_id, entity_id, CASE WHEN entity_id = 'F' THEN created + INTERVAL 36 HOUR ELSE created END AS newest,
      n_rows + CASE WHEN entity_id = 'F' THEN 1 ELSE 0 END AS n_rows,
      CASE WHEN entity_id = 'F' THEN n_rows ELSE 0 END AS added_rows
    FROM latest
    """
)
def add_release(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of all orders gets one more release per finished dataset, which then is the newest."""

    name = f"{scratch_schema(spark)}.dataset_releases"
    history = full_registry(table(spark, sf, "orders"))
    reg.seed_registry(spark, name)
    save_table(history, name, "WRITE_APPEND")
    # One row per pipeline: the five order priorities.
    finished = (
        history.filter(F.col("entity_id") == "F")
        .groupBy("dag_id")
        .agg(F.max("created").alias("created"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    for row in finished:
        at = row["created"].replace(tzinfo=dt.timezone.utc) + dt.timedelta(hours=36)
        added = reg.Release(dag_id=row["dag_id"], entity_id="F", extra={"rows": row["n"]}, created=at, modified=at)
        reg.add_release(spark, name, added)
    rows = spark.table(name).withColumn("added", F.coalesce(F.try_variant_get("extra", "$.rows", "bigint"), F.lit(0)))
    return rows.groupBy("dag_id", "entity_id").agg(
        F.max("created").cast("timestamp_ntz").alias("newest"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max("added").alias("added_rows"),
    )


@query(
    """
    SELECT o_orderpriority AS dag_id, o_orderstatus AS entity_id, 'run-' || CAST(o_orderkey AS VARCHAR) AS dag_run_id,
      o_orderdate AS created, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS snapshot_date,
      o_orderkey AS sequence_start, o_custkey AS custkey FROM orders
    """
)
def release_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    documents = reg.release_to_json(full_registry(table(spark, sf, "orders"))).select("document")
    back = reg.release_from_json(documents, "document")
    return back.select(
        "dag_id",
        "entity_id",
        "dag_run_id",
        F.col("created").cast("timestamp_ntz").alias("created"),
        F.col("snapshot_date").cast("timestamp_ntz").alias("snapshot_date"),
        F.col("sequence_start").cast("bigint").alias("sequence_start"),
        F.variant_get("extra", "$.custkey", "bigint").alias("custkey"),
    )


@query(
    """
    WITH r AS (SELECT DISTINCT o_orderpriority AS table_name, CAST(o_orderdate AS DATE) AS release_date FROM orders),
    v AS (SELECT o_orderpriority AS table_name, CAST(min(o_orderdate) AS DATE) AS version FROM orders
      WHERE o_orderstatus = 'F' GROUP BY 1, year(o_orderdate))
    SELECT r.table_name, r.release_date, max(r.table_name || '_' || CAST(version AS VARCHAR) || '.json') AS path
    FROM r LEFT JOIN v ON v.table_name = r.table_name AND v.version <= r.release_date GROUP BY ALL
    """
)
def schema_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Schema versions begin with a year's first finished order; every order date asks for the one in force."""

    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("table_name"), F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus"
    )
    requests = orders.select("table_name", F.col("date").alias("release_date")).distinct()
    finished = orders.filter(F.col("o_orderstatus") == "F")
    versions = finished.groupBy("table_name", F.year("date").alias("_y")).agg(F.min("date").alias("version"))
    path = F.concat("table_name", F.lit("_"), F.col("version").cast("string"), F.lit(".json"))
    return versions_as_of(requests, versions.select("table_name", "version", path.alias("path")))


@query(
    """
    SELECT 'key' AS column_name, count(*) AS n_null FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'status', count(*) FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'customer', 0
    """
)
def validate_required(spark: SparkSession, sf: str) -> DataFrame:
    schema = schema_from_fields(
        [
            {"name": "key", "type": "INTEGER", "mode": "REQUIRED"},
            {"name": "status", "type": "STRING", "mode": "REQUIRED"},
            {"name": "customer", "type": "INTEGER", "mode": "REQUIRED"},
            {"name": "price", "type": "FLOAT"},
        ]
    )
    rows = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey")).alias("key"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.col("o_custkey").alias("customer"),
        F.col("o_totalprice").alias("price"),
    )
    return required_violations(rows, schema)


def shard_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Table ids: order shards by month per status, and names that only look alike."""

    orders = table(spark, sf, "orders")
    month = F.date_trunc("month", F.col("o_orderdate"))
    shards = orders.select(make_shard_id(F.lit("lake"), F.lower("o_orderstatus"), F.lit("orders"), month).alias("table_id"))
    others = orders.select(
        F.concat(F.lit("lake.f.orders_v"), F.date_format(month, "yyyyMMdd")).alias("table_id")
    ).union(orders.select(F.concat(F.lit("lake.f.orders"), F.date_format(month, "yyyyMM"))))
    return shards.union(others)


@query(
    """
    SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS shard_date FROM orders
    WHERE o_orderstatus = 'F' AND date_trunc('month', o_orderdate) <= DATE '2000-06-15' ORDER BY 1 DESC LIMIT 12
    """
)
def shard_dates(spark: SparkSession, sf: str) -> DataFrame:
    return dates_of_shards(shard_listing(spark, sf), "lake.f.orders", dt.date(2000, 6, 15), 12)


@query(
    """
    SELECT base, base || strftime(max(m), '%Y%m%d') AS table_id FROM (
      SELECT 'lake.' || lower(o_orderstatus) || '.orders' AS base, date_trunc('month', o_orderdate) AS m FROM orders
      UNION ALL SELECT 'lake.f.orders_v', date_trunc('month', o_orderdate) FROM orders)
    WHERE m <= DATE '2000-06-15' GROUP BY 1
    """
)
def latest_table(spark: SparkSession, sf: str) -> DataFrame:
    return newest_tables(shard_listing(spark, sf), dt.date(2000, 6, 15))


KEYS = "(SELECT string_split(url, '://')[2] AS key FROM pages)"


@query(
    rf"""
    SELECT key, 'regex' AS rule FROM {KEYS} WHERE regexp_matches(string_split(key, '/')[-1], '^(?:[0-9]+\.html)')
    UNION ALL SELECT key, 'prefix' FROM {KEYS} WHERE starts_with(key, 'blog.')
    UNION ALL SELECT key, 'glob' FROM {KEYS} WHERE regexp_matches(key, '^[^/]*\.com/en/[^/]*$')
    UNION ALL SELECT key, 'deep' FROM {KEYS} WHERE regexp_matches(key, '^.*/[^/]*\.html$')
    """
)
def select_listed(spark: SparkSession, sf: str) -> DataFrame:
    """The selection rules of a listing, over page addresses as keys."""

    keys = table(spark, sf, "pages").select(F.substring_index("url", "://", -1).alias("key"))

    def chosen(rule: str, **how) -> DataFrame:
        return select_keys(keys, "key", **how).withColumn("rule", F.lit(rule))

    return (
        chosen("regex", regex=r"[0-9]+\.html")
        .union(chosen("prefix", prefix="blog."))
        .union(chosen("glob", glob="*.com/en/*"))
        .union(chosen("deep", glob="**/*.html"))
    )


DOCUMENT_BYTES = "coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes"


@query(
    f"""
    SELECT 'all' AS rule, {DOCUMENT_BYTES} FROM documents GROUP BY ALL
    UNION ALL SELECT 'glob', {DOCUMENT_BYTES} FROM documents WHERE lang = 'en' GROUP BY ALL
    UNION ALL SELECT 'prefix', {DOCUMENT_BYTES} FROM documents WHERE source = 'src1' GROUP BY ALL
    """
)
def list_files(spark: SparkSession, sf: str) -> DataFrame:
    """Text files of all documents by source and language, listed whole, by glob and by prefix: bytes a folder."""

    root = scratch_path(spark, "listed")
    parts = [F.coalesce(c, F.lit("none")).alias(c) for c in ("source", "lang")]
    table(spark, sf, "documents").select(*parts, F.coalesce("text", F.lit(""))).write.partitionBy("source", "lang").text(root)

    def listed(rule: str, **how) -> DataFrame:
        found = files_below(spark, root, **how)
        source, lang = (F.regexp_extract("key", f"{name}=([^/]*)/", 1) for name in ("source", "lang"))
        return found.groupBy(F.lit(rule).alias("rule"), source.alias("source"), lang.alias("lang")).agg(F.sum("length").alias("n_bytes"))

    return union_all(
        [
            listed("all", regex="part-.*[.]txt"),
            listed("glob", regex="part-", glob="**/lang=en/*"),
            listed("prefix", regex="part-", prefix="source=src1/"),
        ]
    )


@query(
    """
    SELECT job, count(*) AS n_operations, count(*) FILTER (status = 'SUCCESS') AS n_success,
      count(*) FILTER (status = 'FAILED') AS n_failed, count(*) FILTER (status = 'ABORTED') AS n_aborted,
      count(*) FILTER (status = 'IN_PROGRESS') AS n_in_progress, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_objects,
      CASE WHEN count(*) FILTER (status = 'SUCCESS') = count(*) THEN 'SUCCESS'
        WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'FAILED'
        WHEN count(*) FILTER (status = 'ABORTED') > 0 THEN 'ABORTED' ELSE 'IN_PROGRESS' END AS state
    FROM (SELECT CAST(user_id AS VARCHAR) || strftime(ts, '-%m-%d') AS job,
      CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'view' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED'
        WHEN 'signup' THEN 'ABORTED' ELSE 'IN_PROGRESS' END AS status,
      CASE WHEN event_type <> 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events)
    GROUP BY job
    """
)
def transfer_rollup(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    operations = table(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), F.date_format("ts", "-MM-dd")).alias("job"),
        F.when(kind.isin("purchase", "view"), "SUCCESS")
        .when(kind == "error", "FAILED")
        .when(kind == "signup", "ABORTED")
        .otherwise("IN_PROGRESS")
        .alias("status"),
        F.when(kind != "click", F.get_json_object("props", "$.k").cast("bigint")).alias("objects_found"),
    )
    return roll_up(operations)


@query(
    """
    WITH s AS (SELECT TIMESTAMP '1995-01-31 06:00:00' + to_months(CAST(i AS INTEGER)) AS b FROM generate_series(0, 80) t(i)),
    sec AS (SELECT b AS section_start, least(TIMESTAMP '2001-06-10', date_trunc('day', b + INTERVAL 1 MONTH) - INTERVAL 1 MICROSECOND)
      AS section_end FROM s WHERE b < TIMESTAMP '2001-06-10')
    SELECT section_start, section_end, count(o_orderkey) AS n_rows FROM sec
    LEFT JOIN orders ON o_orderdate >= section_start AND o_orderdate <= section_end AND o_orderdate < TIMESTAMP '2001-06-10'
    GROUP BY ALL
    """
)
def section_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sections from a month's last day, so that some begin late and leave gaps."""

    start, end = dt.datetime(1995, 1, 31, 6), dt.datetime(2001, 6, 10)
    return count_sections(table(spark, sf, "orders"), "o_orderdate", start, end)


@query(
    """
    SELECT event_type || '_' || CAST(event_id AS VARCHAR) AS name, ts AS created FROM events
    WHERE event_type = 'click' AND TIMESTAMP '2024-01-31' - ts >= INTERVAL 14430 MINUTE
    """
)
def expired(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tables named by type, ten days and half an hour old or more."""

    inventory = table(spark, sf, "events").select(
        F.concat("event_type", F.lit("_"), F.col("event_id").cast("string")).alias("name"), F.col("ts").alias("created")
    )
    return expired_entries(inventory, 240.5, dt.datetime(2024, 1, 31), prefix="click_")


@query(
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
    """
)
def run_query(spark: SparkSession, sf: str) -> DataFrame:
    """SQL with a named parameter, run once its scan estimate is within the budget."""

    sql = f"""
        SELECT l_returnflag, l_linestatus, count(*) AS n_lines, sum(CAST(l_quantity AS BIGINT)) AS quantity
        FROM parquet.`{sf}/lineitem.parquet` WHERE l_shipdate <= :until GROUP BY ALL
    """
    return guarded_query(spark, sql, {"until": dt.datetime(1998, 9, 2)})


@query(
    """
    SELECT 'narrow' AS query, 'run' AS verdict, count(DISTINCT l_suppkey) AS answer FROM lineitem
    UNION ALL SELECT 'wide', 'refused', NULL UNION ALL SELECT 'unfiltered', 'refused', NULL
    UNION ALL SELECT 'one year', 'run', count(*) FROM orders WHERE year(o_orderdate) = 1995
    """
)
def budget_check(spark: SparkSession, sf: str) -> DataFrame:
    """Guarded queries: of a table's bytes a third may be read, and one partitioned table by partition only."""

    dated = f"{scratch_schema(spark)}.dated"
    save_partitioned(table(spark, sf, "orders"), dated, "o_orderdate", "YEAR", require_filter=True)
    lines = f"parquet.`{sf}/lineitem.parquet`"
    budget = estimate_bytes(spark, f"SELECT * FROM {lines}") // 3
    asked = {
        "narrow": (f"SELECT count(DISTINCT l_suppkey) AS answer FROM {lines}", budget),
        "wide": (f"SELECT count(DISTINCT hash(*)) AS answer FROM {lines}", budget),
        "unfiltered": (f"SELECT count(*) AS answer FROM {dated}", DEFAULT_BUDGET),
        "one year": (f"SELECT count(*) AS answer FROM {dated} WHERE o_orderdate_year = '1995'", DEFAULT_BUDGET),
    }
    answers = []
    for name, (sql, most) in asked.items():
        try:
            answer, verdict = guarded_query(spark, sql, bytes_budget=most), "run"
        except (BudgetExceeded, PartitionFilterRequired):
            answer, verdict = spark.range(1).select(F.lit(None).cast("long").alias("answer")), "refused"
        answers.append(answer.select(F.lit(name).alias("query"), F.lit(verdict).alias("verdict"), "answer"))
    return union_all(answers)


@query(
    """
    SELECT o_orderstatus, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 1000 GROUP BY 1
    """
)
def run_template(spark: SparkSession, sf: str) -> DataFrame:
    sql = """
        SELECT o_orderstatus, count(*) AS n_orders, max(IDENTIFIER(:price)) AS top_price FROM {orders}
        WHERE o_orderpriority IN (:first, :second) AND o_totalprice > :least GROUP BY o_orderstatus
    """
    args = {"price": "o_totalprice", "first": "1-URGENT", "second": "2-HIGH", "least": 1000}
    return template(spark, sql, args, {"orders": table(spark, sf, "orders")})
