"""Table ids, object URIs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARD_SUFFIX = r"[0-9]{8}$"
SHARD_FORMAT = "yyyyMMdd"


def _or_fail(ok: Column, value: Column, message: Column) -> Column:
    """``value``, or a failed task with ``message``; null stays null."""

    return F.when(F.coalesce(ok, F.lit(True)), value).otherwise(F.raise_error(message))


def make_table_id(catalog: Column, schema: Column, table: Column) -> Column:
    return F.concat(catalog, F.lit("."), schema, F.lit("."), table)


def make_shard_id(catalog: Column, schema: Column, table: Column, date: Column) -> Column:
    """Table id with the day of ``date`` appended as YYYYMMDD; any time of day is ignored."""

    return F.concat(make_table_id(catalog, schema, table), F.date_format(date, SHARD_FORMAT))


def shard_base(name: Column) -> Column:
    return F.regexp_replace(name, SHARD_SUFFIX, "")


def shard_date(name: Column) -> Column:
    """Date in the last eight digits; null without them, an error when they are no date."""

    return F.when(name.rlike(SHARD_SUFFIX), F.to_date(F.right(name, F.lit(8)), SHARD_FORMAT))


def parse_table_id(table_id: Column) -> Column:
    """Struct of catalog, schema, table name without its shard suffix, and shard date."""

    parts = F.split(table_id, r"\.")
    name = parts[2]
    parsed = F.struct(
        parts[0].alias("catalog"),
        parts[1].alias("schema"),
        shard_base(name).alias("table"),
        shard_date(name).alias("shard_date"),
    )
    return _or_fail(
        F.size(parts) == 3,
        F.when(table_id.isNotNull(), parsed),
        F.concat(F.lit("table id needs three parts: "), table_id),
    )


def object_uri(bucket: Column, key: Column, scheme: str = "gs") -> Column:
    return F.concat(F.lit(f"{scheme}://"), bucket, F.lit("/"), key)


def object_uri_parts(uri: Column, scheme: str = "gs") -> Column:
    """Struct of bucket and key; the key is null when nothing follows the bucket."""

    head = f"{scheme}://"
    rest = F.substring(uri, F.lit(len(head) + 1), F.length(uri))
    bucket = F.substring_index(rest, "/", 1)
    key = F.when(rest.contains("/"), F.substring(rest, F.length(bucket) + 2, F.length(rest)))
    return _or_fail(
        uri.startswith(head),
        F.when(uri.isNotNull(), F.struct(bucket.alias("bucket"), key.alias("key"))),
        F.concat(F.lit(f"uri must start with {head}: "), uri),
    )


def key_from_path(path: Column, root: str) -> Column:
    """Object key of a file below ``root``; a path elsewhere is an error."""

    below = F.substring(path, F.lit(len(root) + 1), F.length(path))
    key = F.trim(F.regexp_replace(below, "/+", "/"), F.lit("/"))
    return _or_fail(path.startswith(root), key, F.concat(F.lit(f"path is not below {root}: "), path))


def filename_from_url(url: Column) -> Column:
    """Text after the last slash, cut at the first question mark."""

    return F.substring_index(F.substring_index(url, "/", -1), "?", 1)


def filename_from_disposition(header: Column, url: Column) -> Column:
    """File name a Content-Disposition header gives (quoted, bare or percent-encoded), else the one in the URL."""

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(header, pattern, 1), F.lit(""))

    quoted = found(r'(?i)(?:^|;)\s*filename\s*=\s*"([^"]*)"')
    bare = found(r'(?i)(?:^|;)\s*filename\s*=\s*([^";\s]+)')
    encoded = F.url_decode(F.replace(found(r"(?i)(?:^|;)\s*filename\*\s*=\s*[^']*'[^']*'([^;\s]+)"), F.lit("+"), F.lit("%2B")))
    return F.coalesce(quoted, bare, encoded, filename_from_url(url))
