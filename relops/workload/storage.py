"""Sources and sinks: every query writes to a fresh folder or schema and reads back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import union_all
from relops.functions.hashing import file_digests as digests_of_files
from relops.functions.text import gunzip_files as gunzip
from relops.functions.text import replace_in_files
from relops.operators.compare import stored_integrity as check_integrity
from relops.operators.registry import release_to_json, write_release_documents
from relops.plans import changefiles, merge, releases
from relops.session import scratch_path
from relops.sinks import export, retention, tables
from relops.sources import files
from relops.sources.records import records_to_df as from_records
from relops.sources.schemas import column_paths as paths_of_columns
from relops.sources.schemas import schema_from_fields
from relops.sources.tables import read_table, stored_facts
from relops.sources.tables import scan_shards as read_shards
from relops.sources.tables import table_inventory as inventory_of
from relops.staging import running_size, stage
from relops.workload.base import query, scratch_schema, table
from relops.workload.incremental import ORDER_UPDATES, order_updates

PARTS_LIMIT = 8192


@query("SELECT * FROM orders")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as gz CSV and back under their schema."""

    orders, path = table(spark, sf, "orders"), scratch_path(spark, "csv")
    export.export_table(orders, path, "csv.gz")
    return files.scan_csv(spark, path, orders.schema, skip_rows=1)


@query("SELECT doc_id, text, lang FROM documents")
def scan_csv_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with quotes, separators and newlines."""

    docs, path = table(spark, sf, "documents").select("doc_id", "text", "lang"), scratch_path(spark, "csv")
    export.export_table(docs, path, "csv")
    return files.scan_csv(spark, path, docs.schema, skip_rows=1, multiline=True)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def scan_csv_skip_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Files that open with a banner and a header: two rows to skip in each, however many files there are."""

    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    folder = scratch_path(spark, "csv")
    status = F.col("o_orderstatus")
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), status)
    body = orders.select(status.alias("part"), F.lit(1).alias("n"), line.alias("value"))
    banner = orders.select(status.alias("part")).distinct().withColumn("n", F.lit(0))
    banner = banner.withColumn("value", F.lit("exported for tests\nkey;customer;status"))
    (
        body.unionByName(banner)
        .repartition("part")
        .sortWithinPartitions("part", "n")
        .select("part", "value")
        .write.partitionBy("part")
        .text(folder)
    )
    return files.scan_csv(spark, f"{folder}/part=*", orders.schema, sep=";", skip_rows=2)


EVENT_FIELDS = schema_from_fields(
    [
        {"name": "event_id", "type": "INTEGER"},
        {"name": "ts", "type": "DATETIME"},
        {"name": "user_id", "type": "INTEGER"},
        {"name": "event_type", "type": "STRING"},
        {"name": "value", "type": "FLOAT"},
        {"name": "props", "type": "STRING"},
    ]
)


@query("SELECT * FROM events")
def scan_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Events as gz JSON lines and back, unknown fields refused."""

    path = scratch_path(spark, "jsonl")
    export.export_table(table(spark, sf, "events"), path, "jsonl.gz")
    return files.scan_jsonl(spark, path, EVENT_FIELDS)


@query("SELECT *, o_orderstatus AS source_part FROM orders")
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    """Several files in one load, each row whole and knowing its file."""

    orders, root = table(spark, sf, "orders"), scratch_path(spark, "files")
    orders.withColumn("part", F.col("o_orderstatus")).write.partitionBy("part").json(root)
    loaded = files.with_source_file(files.scan_jsonl(spark, f"{root}/part=*", orders.schema))
    source = F.regexp_extract("source_file", r"/part=([^/]+)/", 1)
    return loaded.select(*orders.columns, source.alias("source_part"))


@query("SELECT n_name, n_regionkey, count(c_custkey) AS n_customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def records_to_df(spark: SparkSession, sf: str) -> DataFrame:
    """The nations (a fixed handful) as driver-side records, joined to all customers."""

    records = [row.asDict() for row in table(spark, sf, "nation").collect()]
    schema = schema_from_fields(
        [
            {"name": "n_nationkey", "type": "INTEGER", "mode": "REQUIRED"},
            {"name": "n_name", "type": "STRING"},
            {"name": "n_regionkey", "type": "INTEGER"},
        ]
    )
    nations = from_records(spark, records, schema)
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"))
    joined = nations.join(counts, nations["n_nationkey"] == counts["c_nationkey"], "left")
    return joined.select(
        "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_customers")
    )


@query(
    """
    SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_totalprice > 250000 THEN 2 ELSE 1 END AS n_items,
      o_orderpriority AS first_item, 'EUR' AS currency, o_totalprice AS price FROM orders
    """
)
def scan_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as XML documents: attributes, text beside attributes, one or two children of a name."""

    second = F.when(F.col("o_totalprice") > 250000, F.lit("<item>gift</item>")).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<order id="'), F.col("o_orderkey").cast("string"), F.lit('"><status>'), F.col("o_orderstatus"),
        F.lit("</status><item>"), F.col("o_orderpriority"), F.lit("</item>"), second,
        F.lit('<price currency="EUR">'), F.col("o_totalprice").cast("string"), F.lit("</price></order>"),
    )
    schema = "`@id` bigint, status string, item array<string>, price struct<`#text`: double, `@currency`: string>"
    parsed = files.scan_xml(table(spark, sf, "orders").select(xml.alias("xml")), "xml", schema)
    return parsed.select(
        F.col("record.`@id`").alias("id"),
        F.col("record.status").alias("status"),
        F.size("record.item").alias("n_items"),
        F.col("record.item")[0].alias("first_item"),
        F.col("record.price.`@currency`").alias("currency"),
        F.col("record.price.`#text`").alias("price"),
    )


@query(
    """
    SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS shard_date, count(*) AS n_rows, min(o_orderkey) AS first_key
    FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1
    """
)
def scan_shards(spark: SparkSession, sf: str) -> DataFrame:
    """One table per year; the read is bounded on both sides."""

    orders, schema = table(spark, sf, "orders"), scratch_schema(spark)
    first, last = orders.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    for year in range(first, last + 1):
        tables.save_table(orders.filter(F.year("o_orderdate") == year), f"{schema}.orders{year}0101")
    shards = read_shards(spark, f"{schema}.orders", dt.date(1996, 1, 1), dt.date(2000, 12, 31))
    return shards.groupBy("shard_date").agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"))


@query(
    """
    SELECT 'customer' AS table_name, count(*) AS n_rows, true AS has_bytes, true AS is_recent FROM customer
    UNION ALL SELECT 'customer_orders', count(*), true, true FROM orders
    """
)
def table_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Saved tables by prefix, with row and byte counts and creation time."""

    schema = scratch_schema(spark)
    for name, target in (("customer", "customer"), ("orders", "customer_orders"), ("part", "part")):
        tables.save_table(table(spark, sf, name), f"{schema}.{target}")
    listing = inventory_of(spark, schema, "customer", statistics=True)
    return listing.select(
        F.substring_index("table_id", ".", -1).alias("table_name"),
        "n_rows",
        (F.col("n_bytes") > 0).alias("has_bytes"),
        (F.col("created") > F.current_timestamp() - F.expr("INTERVAL 1 DAY")).alias("is_recent"),
    )


@query(
    """
    SELECT * FROM (VALUES ('id', 'bigint'), ('order', 'struct<date:string,items:array<struct<price:double>>,status:string>'),
      ('order.date', 'string'), ('order.items', 'array<struct<price:double>>'), ('order.items.price', 'double'),
      ('order.status', 'string')) AS t(column_name, data_type)
    """
)
def column_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Field paths of nested JSON lines whose schema is inferred from all rows."""

    path = scratch_path(spark, "jsonl")
    nested = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(
            F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"),
            F.array(F.struct(F.col("o_totalprice").alias("price"))).alias("items"),
            F.col("o_orderstatus").alias("status"),
        ).alias("order"),
    )
    export.export_table(nested, path, "jsonl")
    return paths_of_columns(files.scan_jsonl(spark, path)).drop("ordinal")


@query(
    """
    SELECT 'empty' AS step, count(*) AS n_rows FROM orders UNION ALL SELECT 'append', 2 * count(*) FROM orders
    UNION ALL SELECT 'truncate', count(*) FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'replaced by itself', 2 * count(*) FROM orders WHERE o_orderstatus = 'F'
    """
)
def save_table(spark: SparkSession, sf: str) -> DataFrame:
    """The three dispositions in turn, then a table replaced by a query over itself."""

    orders, name = table(spark, sf, "orders"), f"{scratch_schema(spark)}.orders"
    counts = []

    def note(step: str) -> None:
        spark.catalog.refreshTable(name)
        counts.append((step, spark.table(name).count()))

    tables.save_table(orders, name, "WRITE_EMPTY", description="orders", labels={"team": "sales"})
    note("empty")
    tables.save_table(orders, name, "WRITE_APPEND")
    note("append")
    tables.save_table(orders.filter(F.col("o_orderstatus") == "F"), name, "WRITE_TRUNCATE")
    note("truncate")
    tables.save_table(spark.table(name).union(spark.table(name)), name, "WRITE_TRUNCATE")
    note("replaced by itself")
    return spark.createDataFrame(counts, "step string, n_rows bigint")


@query(
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_rows, min(event_id) AS first_id, max(value) AS top_value
    FROM events WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1
    """
)
def save_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Events by day in a table that must be read with bounds; the bounds prune its partitions."""

    name = f"{scratch_schema(spark)}.events"
    tables.save_partitioned(
        table(spark, sf, "events"), name, "ts", "DAY", require_filter=True, cluster_by=["user_id"]
    )
    kept = read_table(spark, name, start=dt.datetime(2024, 1, 5, 12), end=dt.datetime(2024, 1, 20))
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_id"), F.max("value").alias("top_value")
    )


@query("SELECT * FROM lineitem")
def save_clustered(spark: SparkSession, sf: str) -> DataFrame:
    name = f"{scratch_schema(spark)}.lineitem"
    tables.save_clustered(table(spark, sf, "lineitem"), name, ["l_returnflag", "l_partkey"])
    return spark.table(name)


@query("SELECT * FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')")
def save_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines stored by their key: deleting those of pending orders does not shuffle the table again."""

    from relops.operators.incremental import delete_by_keys

    name = f"{scratch_schema(spark)}.lineitem"
    tables.save_bucketed(table(spark, sf, "lineitem"), name, "l_orderkey", 8)
    pending = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    return delete_by_keys(spark.table(name), pending, "l_orderkey", "o_orderkey", co_located=True)


@query("SELECT o_custkey AS customer, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def table_from_query(spark: SparkSession, sf: str) -> DataFrame:
    """A parametrised query stored under a stated schema, clustered and labelled."""

    name = f"{scratch_schema(spark)}.customers"
    schema = schema_from_fields(
        [
            {"name": "customer", "type": "INTEGER", "mode": "REQUIRED"},
            {"name": "n_orders", "type": "INTEGER"},
            {"name": "top_price", "type": "FLOAT"},
        ]
    )
    sql = f"""
        SELECT o_custkey AS customer, count(*) AS n_orders, max(o_totalprice) AS top_price
        FROM parquet.`{sf}/orders.parquet` WHERE o_totalprice > :least GROUP BY o_custkey
    """
    tables.table_from_query(
        spark, sql, name, args={"least": 1000}, schema=schema, cluster_by=["customer"], labels={"kind": "summary"}
    )
    return spark.table(name)


@query(
    """
    SELECT t AS file_type, count(*) AS n_rows, min(ts) AS first_ts, max(event_id) AS last_id, count(DISTINCT props) AS n_props
    FROM events, (VALUES ('csv'), ('csv.gz'), ('jsonl'), ('jsonl.gz')) AS k(t) GROUP BY 1
    """
)
def export_table(spark: SparkSession, sf: str) -> DataFrame:
    """All four file types, read back."""

    events = table(spark, sf, "events")

    def round_trip(kind: str) -> DataFrame:
        path = scratch_path(spark, "export")
        export.export_table(events, path, kind)
        back = (
            files.scan_csv(spark, path, events.schema, skip_rows=1)
            if kind.startswith("csv")
            else files.scan_jsonl(spark, path, events.schema)
        )
        return back.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("ts").alias("first_ts"),
            F.max("event_id").alias("last_id"),
            F.count_distinct("props").alias("n_props"),
        ).withColumn("file_type", F.lit(kind))

    return union_all(round_trip(k) for k in ("csv", "csv.gz", "jsonl", "jsonl.gz"))


@query(
    f"""
    WITH s AS (SELECT doc_id, strlen(text) + 1 AS size,
      coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
    SELECT doc_id, CAST(before AS BIGINT) AS size_before, dense_rank() OVER (ORDER BY before // {PARTS_LIMIT}) - 1 AS part FROM s
    """
)
def export_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Part numbers of all documents in order; single texts are longer than the limit."""

    docs = table(spark, sf, "documents").select("doc_id", "text")
    run = running_size(F.octet_length("text").cast("bigint") + 1)
    return export.assign_parts(docs, run, ["doc_id"], PARTS_LIMIT).select("doc_id", "size_before", "part")


@query(
    f"""
    WITH s AS (SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus || ' ' || CAST(o_orderkey AS VARCHAR) AS line FROM orders),
    b AS (SELECT line, coalesce(sum(strlen(line) + 1) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT 'orders' || lpad(CAST(dense_rank() OVER (ORDER BY slot) - 1 AS VARCHAR), 12, '0') || '.txt' AS part_file, n_lines, n_bytes
    FROM (SELECT before // {PARTS_LIMIT} AS slot, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes FROM b GROUP BY 1)
    """
)
def export_parts_files(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written to disk, their lines and bytes counted again."""

    line = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string"))
    lines = table(spark, sf, "orders").select("o_orderkey", line.alias("line"))
    path = scratch_path(spark, "parts")
    export.export_parts(
        lines, path, ["o_orderkey"], line="line", stem="orders", extension="txt", max_bytes=PARTS_LIMIT
    )
    return (
        spark.read.text(path)
        .groupBy("part_file")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
        )
    )


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def export_parts_gz(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON lines in gz parts, bounded in compressed bytes, and read back from all parts."""

    docs, path = table(spark, sf, "documents"), scratch_path(spark, "parts")
    export.export_parts(docs, path, ["doc_id"], stem="documents", max_bytes=256 * 1024, compress=True)
    return files.scan_jsonl(spark, path, docs.schema, ignore_unknown=True).select(*docs.columns)


@query("SELECT c_nationkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def copy_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables with the same columns copied into one."""

    schema = scratch_schema(spark)
    for name, p in (("customer", "c"), ("supplier", "s")):
        part = table(spark, sf, name).select(F.col(f"{p}_nationkey").alias("key"), F.col(f"{p}_acctbal").alias("balance"))
        tables.save_table(part, f"{schema}.{name}")
    tables.copy_tables(spark, [f"{schema}.customer", f"{schema}.supplier"], f"{schema}.parties")
    return spark.table(f"{schema}.parties")


@query(
    """
    SELECT 'orders' AS name, TRUE AS exists, count(*) AS n_rows, TRUE AS has_bytes, TRUE AS as_expected FROM orders
    UNION ALL SELECT 'customer', TRUE, count(*), TRUE, FALSE FROM customer
    UNION ALL SELECT 'nothing', FALSE, NULL, FALSE, FALSE
    UNION ALL SELECT 'gone', FALSE, NULL, FALSE, TRUE
    """
)
def stored_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Stored tables against what is expected of them: rows, bytes, existence."""

    home, orders = scratch_schema(spark), table(spark, sf, "orders")
    tables.save_partitioned(orders, f"{home}.orders", "o_orderdate", "YEAR")
    tables.save_table(table(spark, sf, "customer"), f"{home}.customer")
    facts = stored_facts(spark, [f"{home}.{n}" for n in ("orders", "customer", "nothing", "gone")])
    wanted = orders.agg(F.count(F.lit(1)).alias("expected_rows")).select(F.lit(f"{home}.orders").alias("table_id"), F.lit(True).alias("exists"), "expected_rows")
    others = [(f"{home}.customer", True, None, 1), (f"{home}.nothing", True, None, None), (f"{home}.gone", False, None, None)]
    stated = spark.createDataFrame(others, "table_id string, exists boolean, expected_rows long, expected_bytes long")
    found = check_integrity(facts, wanted.unionByName(stated, allowMissingColumns=True))
    name = F.substring_index("table_id", ".", -1).alias("name")
    return found.select(name, "exists", "n_rows", F.coalesce(F.col("n_bytes") > 0, F.lit(False)).alias("has_bytes"), "as_expected")


@query("SELECT * FROM customer")
def snapshot_table(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot keeps its rows when the table it was taken of is replaced."""

    schema = scratch_schema(spark)
    tables.save_table(table(spark, sf, "customer"), f"{schema}.customer")
    tables.snapshot_table(spark, f"{schema}.customer", f"{schema}.kept", dt.datetime(2999, 1, 1))
    tables.save_table(table(spark, sf, "customer").limit(0), f"{schema}.customer", "WRITE_TRUNCATE")
    return read_table(spark, f"{schema}.kept")


@query("SELECT o_orderstatus, count(*) AS n_orders FROM orders GROUP BY 1")
def create_view(spark: SparkSession, sf: str) -> DataFrame:
    name = f"{scratch_schema(spark)}.order_states"
    tables.create_view(spark, name, f"SELECT count(*) AS n FROM parquet.`{sf}/orders.parquet`")
    tables.create_view(
        spark, name, f"SELECT o_orderstatus, count(*) AS n_orders FROM parquet.`{sf}/orders.parquet` GROUP BY o_orderstatus"
    )
    return spark.table(name)


@query(
    """
    SELECT count(*) AS n_keys, 0::BIGINT AS n_invalid, CAST(sum(strlen(k) + 2 + CASE WHEN contains(k, ',') THEN 2 ELSE 0 END) AS BIGINT) AS n_bytes
    FROM (SELECT CASE WHEN page_id > 100 THEN string_split(url, '://')[2] ELSE string_split(url, '://')[2] || ',' END AS k FROM pages)
    """
)
def transfer_manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.substring_index("url", "://", -1)
    keys = table(spark, sf, "pages").select(
        F.when(F.col("page_id") > 100, rest).otherwise(F.concat(rest, F.lit(","))).alias("key")
    )
    return export.manifest_check(keys, "key")


@query("SELECT string_split(url, '://')[2] AS key FROM pages")
def transfer_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    keys = table(spark, sf, "pages").select(F.substring_index("url", "://", -1).alias("key"))
    export.transfer_manifest(keys, "key", path)
    return files.scan_csv(spark, path, T.StructType([T.StructField("key", T.StringType())]))


@query(
    """
    SELECT 'nation20240201' AS table_name, n_name AS name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 2
    UNION ALL SELECT 'region', r_name, count(n_nationkey) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 2
    """
)
def load_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk load of small record sets, one of them sharded; the sets are counts per nation and per region."""

    def records(dim: str, dim_key: str, name: str, facts: str, fact_key: str, id_: str) -> list[dict]:
        counts = table(spark, sf, facts).groupBy(F.col(fact_key).alias(dim_key)).agg(F.count(id_).alias("n"))
        rows = table(spark, sf, dim).join(counts, dim_key, "left").select(F.col(name).alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
        return [r.asDict() for r in rows.collect()]

    schema = schema_from_fields([{"name": "name", "type": "STRING"}, {"name": "n", "type": "INTEGER"}])
    home = scratch_schema(spark)
    specs = [
        tables.TableSpec(
            schema_name=home,
            table_name="nation",
            records=records("nation", "n_nationkey", "n_name", "customer", "c_nationkey", "c_custkey"),
            schema=schema,
            is_sharded=True,
        ),
        tables.TableSpec(
            schema_name=home,
            table_name="region",
            records=records("region", "r_regionkey", "r_name", "nation", "n_regionkey", "n_nationkey"),
            schema=schema,
        ),
    ]
    loaded = tables.load_tables(spark, specs, dt.date(2024, 2, 1))
    return union_all(
        spark.table(n).select(F.lit(n.split(".")[-1]).alias("table_name"), "name", "n") for n in loaded
    )


@query("SELECT DISTINCT lower(o_orderpriority) || '-' || o_orderstatus AS id FROM orders")
def release_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The latest release of each dataset as one JSON document per id; the ids found on disk."""

    from relops.operators.registry import latest_releases
    from relops.workload.registry import full_registry

    latest = latest_releases(full_registry(table(spark, sf, "orders")), "created", tie_break="sequence_start")
    documents = release_to_json(latest).withColumn("id", F.concat(F.lower("dag_id"), F.lit("-"), F.col("entity_id")))
    path = scratch_path(spark, "documents")
    write_release_documents(documents.select("id", "document"), "document", path, "id")
    return spark.read.text(f"{path}/releases").select("id")


@query(
    r"""
    SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line_number, unnest(lines) AS line
    FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[aeiou]+', '*', 'g'), chr(10)) AS lines FROM documents)
    """
)
def replace_in_text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered lines of all texts written as gz text, rewritten by a pattern, read back."""

    src, dst = scratch_path(spark, "text"), scratch_path(spark, "text")
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")
    numbered = table(spark, sf, "documents").select("doc_id", lines)
    numbered = numbered.select(F.concat_ws("\t", F.col("doc_id").cast("string"), (F.col("at") + 1).cast("string"), "line"))
    numbered.write.option("compression", "gzip").text(src)
    replace_in_files(spark, src, dst, "[aeiou]+", "*")
    parts = F.split("value", "\t", 3)
    return spark.read.text(dst).select(
        parts[0].cast("bigint").alias("doc_id"), parts[1].cast("bigint").alias("line_number"), parts[2].alias("line")
    )


@query(
    """
    WITH c AS (SELECT event_id, user_id, event_type, value, (day(ts) - 1) // 10 AS seq FROM events)
    SELECT event_id, user_id, event_type, value FROM c QUALIFY seq = max(seq) OVER (PARTITION BY user_id)
    """
)
def merge_changefile_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Four change files of ten days each, merged as text."""

    root, target = scratch_path(spark, "changes"), scratch_path(spark, "merged")
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", ((F.dayofmonth("ts") - 1) / 10).cast("int").alias("file")
    )
    rows.write.partitionBy("file").json(root)
    numbers = [r["file"] for r in spark.read.json(root).select("file").distinct().orderBy("file").collect()]
    changefiles.merge_changefile_texts(spark, [f"{root}/file={n}" for n in numbers], "user_id", target)
    return files.scan_jsonl(spark, target, rows.drop("file").schema)


@query("SELECT * FROM events")
def load_files(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines loaded in one call into a table partitioned by day and clustered by user."""

    path, name = scratch_path(spark, "jsonl"), f"{scratch_schema(spark)}.events"
    export.export_table(table(spark, sf, "events"), path, "jsonl.gz")
    layout = tables.Layout(partition_field="ts", cluster_by=("user_id",))
    if not tables.load_files(spark, path, name, EVENT_FIELDS, "jsonl", layout=layout):
        raise RuntimeError("the load was rejected")
    return read_table(spark, name)


@query(
    f"""
    WITH u AS ({ORDER_UPDATES})
    SELECT * FROM u
    UNION ALL SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.o_orderkey = o.o_orderkey)
    """
)
def upsert_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same upsert on stored tables: main is partitioned by month and stays so."""

    home, orders = scratch_schema(spark), table(spark, sf, "orders")
    layout = tables.Layout(partition_field="o_orderdate", partition_kind="MONTH")
    tables.save_table(orders, f"{home}.orders", layout=layout)
    tables.save_table(order_updates(orders), f"{home}.updates")
    merge.upsert_table(spark, f"{home}.orders", f"{home}.updates", "o_orderkey")
    return tables.whole_table(spark, f"{home}.orders")


@query(
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders, CAST(sum(CASE WHEN hit THEN 0 ELSE o_totalprice END) AS DOUBLE) AS price,
      bool_or(hit) AS rewritten
    FROM (SELECT *, coalesce(year(o_orderdate) = 1995 AND o_totalprice > 300000, FALSE) AS hit FROM orders) GROUP BY 1
    """
)
def merge_touched_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """An upsert of the dear orders of one year: which months got new files, all others kept theirs."""

    name, orders = f"{scratch_schema(spark)}.orders", table(spark, sf, "orders")
    tables.save_partitioned(orders, name, "o_orderdate", "MONTH")

    def held(label: str) -> DataFrame:
        file = F.col("_metadata.file_path").alias("file")
        return spark.table(name).select(F.col("o_orderdate_month").alias(label), file).distinct()

    before = stage(held("was"))
    dear = orders.filter((F.year("o_orderdate") == 1995) & (F.col("o_totalprice") > 300000))
    merge.change_table(spark, name, dear.withColumn("o_totalprice", F.lit(0).cast(orders.schema["o_totalprice"].dataType)), None, "o_orderkey")
    fresh = held("month").join(before, "file", "left").groupBy("month").agg((F.count_if(F.col("was").isNull()) > 0).alias("rewritten"))
    price = F.sum("o_totalprice").cast("double").alias("price")
    totals = spark.table(name).groupBy(F.col("o_orderdate_month").alias("of")).agg(F.count(F.lit(1)).alias("n_orders"), price)
    return totals.join(fresh, totals["of"].eqNullSafe(fresh["month"])).select("month", "n_orders", "price", "rewritten")


@query(
    f"""
    WITH u AS ({ORDER_UPDATES}), m AS (
    SELECT * FROM u
    UNION ALL SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.o_orderkey = o.o_orderkey))
    SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = 'R' AND l.l_orderkey = m.o_orderkey)
    """
)
def upsert_grouped_table(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert and delete of a table grouped by its key: the groups to rewrite follow from the changes alone."""

    name, orders = f"{scratch_schema(spark)}.orders", table(spark, sf, "orders")
    tables.save_grouped(orders, name, "o_orderkey", 16)
    returned = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select("l_orderkey")
    merge.change_table(spark, name, stage(order_updates(orders)), returned, "o_orderkey", "l_orderkey")
    return tables.whole_table(spark, name)


@query("SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'P' AND o.o_custkey = c.c_custkey)")
def delete_from_table(spark: SparkSession, sf: str) -> DataFrame:
    """A delete between stored tables, main bucketed by its key."""

    home = scratch_schema(spark)
    tables.save_bucketed(table(spark, sf, "customer"), f"{home}.customer", "c_custkey", 8)
    tables.save_table(table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P"), f"{home}.pending")
    merge.delete_from_table(spark, f"{home}.customer", f"{home}.pending", "c_custkey", "o_custkey")
    return tables.whole_table(spark, f"{home}.customer")


CHANGES = """
  SELECT CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1000000000 ELSE o_custkey END AS c_custkey,
    'Changed' AS c_name, 1 AS c_nationkey, max(o_totalprice) AS c_acctbal, 'CHANGED' AS c_mktsegment,
    CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS seq
  FROM orders GROUP BY ALL
"""


def customer_changes(orders: DataFrame) -> DataFrame:
    """Monthly change files of customers: their dearest order as balance, pending orders as new customers."""

    key = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey"))
    month = F.date_format("o_orderdate", "yyyyMM").cast("bigint")
    per_file = orders.groupBy(key.alias("c_custkey"), month.alias("seq")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return per_file.select(
        "c_custkey",
        F.lit("Changed").alias("c_name"),
        F.lit(1).alias("c_nationkey"),
        "c_acctbal",
        F.lit("CHANGED").alias("c_mktsegment"),
        "seq",
    )


@query(
    f"""
    WITH c AS ({CHANGES}), u AS (SELECT * EXCLUDE seq FROM c QUALIFY seq = max(seq) OVER (PARTITION BY c_custkey)),
    m AS (SELECT * FROM u UNION ALL SELECT * FROM customer k WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.c_custkey = k.c_custkey))
    SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_mktsegment = 'BUILDING' AND d.c_custkey = m.c_custkey)
    """
)
def apply_changefile_release(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot, merge of monthly change files, upsert, delete and registration of one release."""

    home = scratch_schema(spark)
    customers = table(spark, sf, "customer")
    tables.save_table(customers, f"{home}.customer")
    target = releases.Target(
        table=f"{home}.customer", registry=f"{home}.dataset_releases", dag_id="customers", entity_id="customer"
    )
    return releases.apply_changefile_release(
        spark,
        target,
        customer_changes(table(spark, sf, "orders")),
        customers.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey"),
        "c_custkey",
        "seq",
        start_date=dt.datetime(1995, 1, 1),
        end_date=dt.datetime(2001, 8, 1),
        now=dt.datetime(2024, 1, 1),
        snapshot=f"{home}.customer_before",
        snapshot_expires_at=dt.datetime(2999, 1, 1),
    )


@query(
    f"""
    WITH c AS ({CHANGES}), u AS (SELECT * EXCLUDE seq FROM c QUALIFY seq = max(seq) OVER (PARTITION BY c_custkey))
    SELECT * FROM u
    UNION ALL SELECT * FROM customer k WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.c_custkey = k.c_custkey)
    """
)
def changefile_result(spark: SparkSession, sf: str) -> DataFrame:
    """The same merge as one query, nothing stored."""

    changes = customer_changes(table(spark, sf, "orders"))
    return releases.changefile_result(table(spark, sf, "customer"), changes, None, "c_custkey", "seq")


@query(
    """
    SELECT o_orderstatus, n, DATE '2024-02-01' AS shard_date FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
    UNION ALL SELECT o_orderstatus, n, DATE '2024-03-01' FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1)
    """
)
def apply_snapshot_release(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots become two shards."""

    home = scratch_schema(spark)
    target = releases.Target(table=f"{home}.orders", registry=f"{home}.dataset_releases", dag_id="orders", entity_id="order")
    orders = table(spark, sf, "orders")
    now = dt.datetime(2024, 3, 2)
    releases.apply_snapshot_release(spark, target, orders, dt.datetime(2024, 2, 1), now)
    dear = orders.filter(F.col("o_totalprice") > 1000)
    releases.apply_snapshot_release(spark, target, dear, dt.datetime(2024, 3, 1), now)
    shards = read_shards(spark, target.table)
    return shards.groupBy("o_orderstatus", "shard_date").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT event_id, event_type, DATE '2024-02-01' AS snapshot_date FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_id, event_type, DATE '2024-02-02' FROM events WHERE event_type <> 'click'
    """
)
def apply_partition_release(spark: SparkSession, sf: str) -> DataFrame:
    """A partition published twice: the second release replaces it and leaves the other alone."""

    home = scratch_schema(spark)
    target = releases.Target(table=f"{home}.events", registry=f"{home}.dataset_releases", dag_id="events", entity_id="event")
    events = table(spark, sf, "events").select("event_id", "event_type")
    clicks = F.col("event_type") == "click"
    for rows, day in ((events.filter(clicks), 1), (events, 2), (events.filter(~clicks), 2)):
        releases.apply_partition_release(spark, target, rows, dt.datetime(2024, 2, day), dt.datetime(2024, 2, 3))
    return read_table(spark, target.table).select("event_id", "event_type", "snapshot_date")




@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """CSV read without a schema: names from the header, types from the values."""

    path = scratch_path(spark, "csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    export.export_table(orders, path, "csv")
    found = files.scan_csv(spark, path)
    return found.select(*[F.col(c).cast(orders.schema[c].dataType) for c in orders.columns])


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def scan_xml_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as elements of XML files: key as attribute, an element left out where there is no value."""

    def element(tag: str, value) -> F.Column:
        return F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))

    path, customers = scratch_path(spark, "xml"), table(spark, sf, "customer")
    segment = F.when(F.col("c_custkey") % 3 != 0, element("segment", F.col("c_mktsegment")))
    parts = [element("name", F.col("c_name")), element("balance", F.col("c_acctbal").cast("string")), F.coalesce(segment, F.lit(""))]
    head = F.concat(F.lit('<customer key="'), F.col("c_custkey").cast("string"), F.lit('">'))
    file = F.pmod("c_custkey", F.lit(8)).alias("file")
    lines = customers.select(file, F.lit(1).alias("place"), F.concat(head, *parts, F.lit("</customer>")).alias("value"))
    ends = spark.range(8).select("id", F.explode(F.expr("map(0, '<customers>', 2, '</customers>')")).alias("place", "value"))
    placed = lines.union(ends.select("id", "place", "value")).repartition("file").sortWithinPartitions("file", "place")
    placed.select("value", "file").write.partitionBy("file").text(path)
    balance = customers.schema["c_acctbal"].dataType.simpleString()
    found = files.scan_xml_files(spark, f"{path}/file=*", "customer", f"`@key` bigint, name string, balance {balance}, segment string")
    return found.select(F.col("@key").alias("c_custkey"), F.col("name").alias("c_name"), F.col("balance").alias("c_acctbal"), "segment")


@query("SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE NOT contains(text, chr(13))")
def gunzip_files(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed text files written out plain."""

    packed, plain = scratch_path(spark, "packed"), scratch_path(spark, "plain")
    docs = table(spark, sf, "documents").filter(~F.contains("text", F.lit("\r")))
    docs.select("text").write.option("compression", "gzip").text(packed)
    gunzip(spark, packed, plain)
    names = spark.read.format("binaryFile").load(plain).select("path")
    if not names.filter(~F.col("path").endswith(".txt")).isEmpty():
        raise RuntimeError("a file is still compressed")
    return spark.read.text(plain).select(F.col("value").alias("line"))


WHOLE_FILE = "string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)"


@query(
    f"""
    SELECT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, CAST(strlen({WHOLE_FILE}) AS BIGINT) AS length, md5({WHOLE_FILE}) AS digest
    FROM documents GROUP BY ALL
    """
)
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of files: one for the documents of a source and language, in the order of their ids."""

    root = scratch_path(spark, "files")
    parts = [F.coalesce(c, F.lit("none")).alias(c) for c in ("source", "lang")]
    docs = table(spark, sf, "documents").select(*parts, "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    placed = docs.repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id").drop("doc_id")
    placed.write.partitionBy("source", "lang").text(root)
    found = digests_of_files(spark, root)
    return found.select(*[F.regexp_extract("path", f"/{n}=([^/]*)/", 1).alias(n) for n in ("source", "lang")], "length", "digest")


@query("SELECT o_orderstatus AS name, count(*) AS n_rows FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def drop_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in a table per status, of which those with a prefix expire; what is left, by the inventory."""

    home, orders = scratch_schema(spark), table(spark, sf, "orders")
    for row in orders.select("o_orderstatus").distinct().collect():
        status = row["o_orderstatus"]
        name = f"{'finished' if status == 'F' else 'open'}_{status}".lower()
        tables.save_table(orders.filter(F.col("o_orderstatus") == status), f"{home}.{name}")
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=30)
    retention.drop_expired(spark, inventory_of(spark, home), 48, later, f"{home}.")
    retention.drop_expired(spark, inventory_of(spark, home), 24, later, f"{home}.finished_")
    left = inventory_of(spark, home, statistics=True)
    return left.select(F.upper(F.substring_index("table_id", "_", -1)).alias("name"), "n_rows")
