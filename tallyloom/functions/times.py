"""Instants, epochs, local time and labels. Unknown times are NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted layouts.
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})$"
SPACED_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})$"
LOCAL_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def parse_rfc3339(c: Column) -> Column:
    """Strict: date, time and zone are all required."""
    return F.when(c.rlike(RFC3339_PATTERN), F.try_to_timestamp(c))


def parse_index_time(c: Column) -> Column:
    """RFC 3339, or the same with a space between date and time."""
    return F.when(c.rlike(RFC3339_PATTERN) | c.rlike(SPACED_PATTERN), F.try_to_timestamp(c))


def from_millis(c: Column) -> Column:
    return F.when(c > 0, F.timestamp_millis(c))


def from_seconds(c: Column) -> Column:
    """Whole or fractional epoch seconds."""
    return F.when(c > 0, F.timestamp_seconds(c))


def parse_or_seconds(c: Column) -> Column:
    """RFC 3339, else epoch seconds written as text."""
    return F.coalesce(parse_rfc3339(c), from_seconds(c.try_cast("double")))


def parse_json_time(c: Column) -> Column:
    """RFC 3339 text, else epoch milliseconds."""
    return F.coalesce(parse_rfc3339(c), from_millis(c.try_cast("bigint")))


def parse_local(c: Column, zone: str) -> Column:
    """A zone-less wall-clock time read in ``zone``."""
    text = F.trim(c)
    return F.when(text.rlike(LOCAL_PATTERN),
                  F.to_utc_timestamp(F.try_to_timestamp(text), F.lit(zone)))


def to_local(c: Column, zone: str) -> Column:
    return F.from_utc_timestamp(c, F.lit(zone))


def round1(c: Column) -> Column:
    """One decimal, half away from zero."""
    return F.round(c, 1)


def is_calendar_year(start: Column, end: Column) -> Column:
    """Both local instants in one year, from the first week to the last."""
    return F.coalesce(
        (F.year(start) == F.year(end)) & (F.month(start) == 1) & (F.dayofmonth(start) <= 7)
        & (F.month(end) == 12) & (F.dayofmonth(end) >= 25), F.lit(False))


def coverage_label(start: Column, end: Column) -> Column:
    """Label of a local span: a year, or two dates joined by an em dash."""
    full = F.concat_ws(" — ", F.date_format(start, "MMM d, yyyy"), F.date_format(end, "MMM d, yyyy"))
    short = F.concat_ws(" — ", F.date_format(start, "MMM d"), F.date_format(end, "MMM d, yyyy"))
    return (F.when(start.isNull() | end.isNull(), F.lit("No local history found"))
             .when(is_calendar_year(start, end), F.year(start).cast("string"))
             .when(F.year(start) == F.year(end), short).otherwise(full))


def timezone_label(zone: str, reference: Column) -> Column:
    """Zone name; a bare offset is spelt as local time at the span start."""
    if not zone[:1] in "+-":
        return F.lit(zone)
    return F.concat(F.lit("Local time (UTC"), F.lit(zone), F.lit(" at span start)"))
