"""Time columns. Wall clock is kept: timestamps have no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(text: Column) -> Column:
    """Compact stamp, ISO date-time or date to a timestamp without zone; null if none fits. A zone suffix is cut off."""
    plain = F.regexp_replace(text, r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    compact = F.when(
        text.rlike(r"^\d{8}T\d{6}Z?$"),
        F.concat(
            F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2), F.lit(" "),
            F.substring(text, 10, 2), F.lit(":"), F.substring(text, 12, 2), F.lit(":"), F.substring(text, 14, 2),
        ),
    )
    # a plain date's own dashes must not read as a zone
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(F.replace(plain, F.lit("T"), F.lit(" ")))
    return F.coalesce(compact, whole).try_cast("timestamp_ntz")


def compact_ts(text: Column) -> Column:
    """yyyyMMddTHHmmssZ of a parsable time, wall clock kept; null otherwise."""
    return F.date_format(parse_ts(text), "yyyyMMdd'T'HHmmss'Z'")


def rfc2822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0000'")


def seconds_of(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def hours_since(ts: Column, now: Column) -> Column:
    return F.round((seconds_of(now) - seconds_of(ts)) / 3600.0, 2)


def days_since(ts: Column, now: Column) -> Column:
    return F.datediff(now, ts)


def to_ns(text: Column) -> Column:
    """RFC 3339 UTC time with up to nine fraction digits to epoch nanoseconds."""
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0").cast("bigint")
    return seconds_of(F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")) * 1_000_000_000 + F.coalesce(
        fraction, F.lit(0)
    )


def ns_to_iso(ns: Column) -> Column:
    whole = F.timestamp_add("SECOND", F.floor(ns / F.lit(1_000_000_000)), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(
        F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((ns % 1_000_000_000).cast("string"), 9, "0"), F.lit("Z")
    )


def corrected_end_date(name: Column, identifier: Column, end: Column) -> Column:
    """End of a session whose name (else identifier) is a range of years that goes one year past the given end:
    31 December of the last year. Other ends stay."""
    span = r"20\d{2}\D{0,3}(20\d{2})"
    last = [F.nullif(F.regexp_extract(c, span, 1), F.lit("")) for c in (name, identifier)]
    year = F.coalesce(*last).cast("int")
    return F.when(year - F.year(end) == 1, F.make_date(year, F.lit(12), F.lit(31))).otherwise(end)


def log_timestamp(path: Column) -> Column:
    """Leading stamp of a log's file name."""
    return F.nullif(F.regexp_extract(path, r"/logs/(\d{8}T\d{6}Z)", 1), F.lit(""))


def legacy_timestamp(path: Column) -> Column:
    """The command line's older rule: the file name up to its first underscore, null without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("_"), F.substring_index(name, "_", 1))
