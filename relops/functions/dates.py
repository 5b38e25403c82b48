"""Timestamps as text, lenient parsing and monthly fetch sections. Sessions run in UTC."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats tried by default, in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd")
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS z",)

# Layouts tried after the ISO forms that a plain cast reads; a zone offset may follow each.
OTHER_LAYOUTS = (
    "yyyy-M-d H:mm",
    "yyyy-M-d'T'H:mm",
    "yyyyMMdd",
    "yyyyMMdd'T'HHmmss",
    "yyyyMMddHHmmss",
    "yyyy/M/d",
    "yyyy/M/d H:mm[:ss]",
    "M/d/yyyy",
    "M/d/yyyy H:mm[:ss]",
    "M/d/yyyy h:mm[:ss] a",
    "d MMM yyyy",
    "d MMM yyyy H:mm[:ss]",
    "d MMMM yyyy",
    "d MMMM yyyy H:mm[:ss]",
    "MMM d, yyyy",
    "MMM d, yyyy H:mm[:ss]",
    "MMMM d, yyyy",
    "MMMM d, yyyy H:mm[:ss]",
)
_OFFSETS = "[XXX][XX][X]"

_ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_WEEKDAY = r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
_CLOCK = r"(:[0-9]{2}(?:[.,][0-9]+)?)\s*"


def iso_text(ts: Column, zone: str) -> Column:
    """ISO text of a timestamp, microseconds only when there are any, then ``zone``."""

    return F.concat(F.replace(F.date_format(ts, _ISO_MICROS), F.lit(".000000"), F.lit("")), F.lit(zone))


def parse_datetime(text: Column, layouts: Sequence[str] = OTHER_LAYOUTS) -> Column:
    """UTC timestamp of a date-time text; no zone means UTC; null when no layout fits.

    After a zone name the offset counts the POSIX way, so ``UTC+1`` is an hour behind and its sign is turned.
    A zone name alone says nothing more than UTC.
    """

    clean = F.regexp_replace(F.trim(text), _WEEKDAY, "")
    clean = F.regexp_replace(clean, _CLOCK + r"[A-Za-z]{3,5}[+](?=[0-9])", "$1-")
    clean = F.regexp_replace(clean, _CLOCK + r"[A-Za-z]{3,5}-(?=[0-9])", "$1+")
    clean = F.regexp_replace(clean, _CLOCK + r"(?:[A-Za-z]{3,5}$|(?=[+-]))", "$1")

    def other(c: Column) -> Column:
        tried = [F.try_to_timestamp(c, F.lit(layout + _OFFSETS)) for layout in layouts]
        return F.coalesce(F.replace(c, F.lit(","), F.lit(".")).try_cast("timestamp"), *tried)

    # ISO text stays in generated code; the rare rest binds its text once as a lambda argument.
    return F.coalesce(clean.try_cast("timestamp"), F.transform(F.array(clean), other)[0])


def normalise_datetime(text: Column, strict: bool = True) -> Column:
    """Any timestamp text as UTC ISO text ending in ``+00:00``; unreadable text fails, or is null if not strict."""

    iso = iso_text(parse_datetime(text), "+00:00")
    if not strict:
        return iso
    unreadable = F.raise_error(F.concat(F.lit("not a date-time: "), text)).cast("string")
    return F.coalesce(iso, F.when(text.isNotNull(), unreadable))


def to_release_timestamp(text: Column) -> Column:
    """Registry ISO text as a timestamp; null stays null, other text is an error."""

    return text.cast("timestamp")


def from_release_timestamp(ts: Column) -> Column:
    """Registry text of a timestamp, ending in ``Z``; null stays null."""

    return iso_text(ts, "Z")


def parse_date_text(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date by the first format that fits, else by the lenient reader, else null."""

    tried = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    return F.coalesce(*tried, parse_datetime(text).cast("date"))


def parse_timestamp_text(text: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """Timestamp by the first format that fits, else by the lenient reader, else null."""

    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], parse_datetime(text))


def partition_stamp(date: dt.date | Column, kind: str = "DAY") -> Column:
    """Text of a partition date: full ISO for HOUR, the plain day for DAY, MONTH and YEAR."""

    if isinstance(date, Column):
        return iso_text(date, "") if kind == "HOUR" else F.date_format(date, "yyyy-MM-dd")
    return F.lit(date.isoformat() if kind == "HOUR" else date.strftime("%Y-%m-%d"))


def monthly_sections(start: Column, end: Column, as_dates: bool = False) -> Column:
    """Array of (section_start, section_end): one section per month counted from ``start``, while before ``end``.

    A section ends with the day before its monthly anniversary, or at ``end``. With ``as_dates`` the bounds are
    dates, else timestamps ending at the last microsecond of the day.
    """

    kind = "date" if as_dates else "timestamp_ntz"
    start, end = start.cast(kind), end.cast(kind)
    month, day, tick = F.expr("INTERVAL 1 MONTH"), F.expr("INTERVAL 1 DAY"), F.expr("INTERVAL 1 MICROSECOND")

    def section(s: Column) -> Column:
        if as_dates:
            last = F.date_sub(F.add_months(s, 1), 1)
        else:
            last = (s + month).cast("date").cast("timestamp_ntz") - tick
        return F.struct(s.alias("section_start"), F.least(end, last).alias("section_end"))

    starts = F.filter(F.sequence(start, F.greatest(start, end), month), lambda s: s < end)
    return F.transform(starts, section)


def section_index(ts: Column, start: Column) -> Column:
    """Number of the monthly section a timestamp may lie in: whole months since ``start``, by arithmetic alone."""

    months = (F.year(ts) - F.year(start)) * 12 + F.month(ts) - F.month(start)
    begins = start + F.make_ym_interval(F.lit(0), months)
    return F.when(ts >= begins, months).otherwise(months - 1)
