"""Timestamp normalisation, intervals and duration texts.

All clocks are arguments.  Sessions run in UTC, so naive and UTC agree.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage.functions.netaddr import col

MILLISECONDS_ABOVE = 1_000_000_000_000
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
VERSION_SENTINEL = "1970-01-01 00:00:00"


def epoch(value: Column | str) -> Column:
    """Number, numeric text or ISO text to epoch seconds.

    Values above 1e12 are milliseconds; negative or unreadable values are null;
    fractions are cut off.
    """
    text = F.regexp_replace(col(value).cast("string"), r"^\s+|\s+$", "")
    number = F.when(text.rlike(NUMBER_RE), text.try_cast("double"))
    stamp = F.when(text.rlike(r"^\d{4}-?\d{2}-?\d{2}"), F.try_to_timestamp(text))
    seconds = F.coalesce(number, F.unix_micros(stamp) / 1_000_000.0)
    seconds = F.when(seconds > MILLISECONDS_ABOVE, seconds / 1000).otherwise(seconds)
    return F.when((seconds >= 0) & (seconds <= 1.0e15), F.floor(seconds).cast("bigint"))


def seen_range(first: Column, last: Column) -> tuple[Column, Column]:
    """Ordered interval; a missing side is copied from the other."""
    low = F.coalesce(first, last)
    high = F.coalesce(last, first)
    return F.least(low, high), F.greatest(low, high)


def iso(seconds: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def short_date(seconds: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(seconds)), "dd/MM/yy")


def add_months(stamp: Column, months: int) -> Column:
    """Month arithmetic on timestamps: time kept, day clamped."""
    return stamp + F.make_interval(months=F.lit(months))


def ts(value: dt.datetime | Column) -> Column:
    """Literal or column to a session-zone TIMESTAMP."""
    if isinstance(value, dt.datetime):
        value = F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f"))
    return value.cast("timestamp")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, cut towards zero."""
    return ((F.unix_micros(ts(end)) - F.unix_micros(ts(start))) / 1_000_000).cast("bigint")


def _clock(seconds: Column, hours: bool) -> Column:
    h = F.floor(seconds / 3600)
    m = F.floor((seconds - h * 3600) / 60) if hours else F.floor(seconds / 60)
    s = seconds - (h * 3600 if hours else F.lit(0)) - m * 60
    minutes = F.when(m != 0, F.format_string("%02d:%02d", m, s)).otherwise(F.concat(s.cast("string"), F.lit("s")))
    if not hours:
        return minutes
    return F.when(h != 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(minutes)


def duration_text(start: Column, end: Column) -> Column:
    """``HH:MM:SS`` / ``MM:SS`` / ``Ns``; infinity sign if an end is missing."""
    return F.coalesce(_clock(seconds_between(start, end), True), F.lit("∞"))


def cycle_duration_text(start: Column, end: Column, now: Column) -> Column:
    """Elapsed or final cycle time, never negative; empty without a start."""
    seconds = F.greatest(seconds_between(start, F.coalesce(ts(end), ts(now))), F.lit(0).cast("bigint"))
    return F.coalesce(_clock(seconds, True), F.lit(""))


def job_duration_text(start: Column, end: Column) -> Column:
    """Job form: minutes are not split into hours; ``oo`` if an end is missing."""
    return F.coalesce(_clock(seconds_between(start, end), False), F.lit("oo"))


def percent(done: Column, total: Column) -> Column:
    """Progress in 0..100; 0 when there is nothing to do."""
    done = F.coalesce(done, F.lit(0)).cast("double")
    total = F.coalesce(total, F.lit(0)).cast("double")
    return F.when(total <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), done / total * 100))
    )


def rule_version(text: Column | str) -> Column:
    """Rule file version stamp to a UTC timestamp.

    Three compact forms and ISO are accepted, a missing stamp is the 1970
    sentinel, an unreadable one is null.
    """
    value = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^\s+|\s+$", "")
    # Accepted stamp formats.
    formats = ("yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parsed = [F.try_to_timestamp(value, F.lit(f)) for f in formats]
    plain = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value))
    return F.when(value == "", F.lit(VERSION_SENTINEL).cast("timestamp")).otherwise(
        F.coalesce(*parsed, plain)
    )
