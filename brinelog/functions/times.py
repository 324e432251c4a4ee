"""Time formats and conversions as Column expressions (session time zone UTC)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of the feed and of sample identifiers.
ISO_8601 = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_8601_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
RFC_822 = "EEE, dd MMM yyyy HH:mm:ss +0000"
PID_V1_TIME = "yyyy_DDD_HHmmss"
PID_V2_TIME = "yyyyMMdd'T'HHmmss"
DATE_PARAM_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
]


def instant(value: datetime | str) -> Column:
    """Literal timestamp without zone, so that it compares with stored times without a cast of the column."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, ISO_8601)


def iso8601ms(ts: Column) -> Column:
    return F.date_format(ts, ISO_8601_MS)


def rfc822(ts: Column) -> Column:
    return F.date_format(ts, RFC_822)


def message_prefix(message: Column, ts: Column, separator: str = " ", fmt: str = ISO_8601) -> Column:
    return F.concat_ws(separator, F.date_format(ts, fmt), message)


def parse_time(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_date_param(text: Column) -> Column:
    """First of the five ISO forms that fits; else the text without its fraction; else null."""
    tries = [parse_time(text, f) for f in DATE_PARAM_FORMATS]
    tries.append(parse_time(F.regexp_replace(text, r"\.\d+Z?", ""), DATE_PARAM_FORMATS[1]))
    return F.coalesce(*tries)


def epoch_to_utc(seconds: Column) -> Column:
    return F.timestamp_seconds(F.floor(seconds)).cast("timestamp_ntz")


def as_utc(ts: Column) -> Column:
    """Whole seconds; a time without zone is taken as UTC."""
    return F.date_trunc("second", ts).cast("timestamp_ntz")


def local_to_utc(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts, zone).cast("timestamp_ntz")


def utc_to_local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone).cast("timestamp_ntz")


def make_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    whole = [c.cast("int") for c in (year, month, day, hour, minute, second)]
    return F.make_timestamp(*whole).cast("timestamp_ntz")


def add_seconds(ts: Column, seconds: Column) -> Column:
    """Time plus fractional seconds, to the microsecond."""
    return F.timestamp_micros(micros(ts) + F.round(seconds * 1000000).cast("bigint")).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1000000.0)


def utc_text(ts: Column) -> Column:
    """ISO text on the 24-hour clock."""
    return F.date_format(ts, ISO_8601)
