"""Dates and schedules. Timestamps are in the session's zone, which is UTC."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_days(interval: Column, custom: Column) -> Column:
    """1, 7, 30 or 365; else the custom days, at least 1, and 30 where they are missing or no number."""
    days = F.when(F.coalesce(custom, F.lit("")) == "", F.lit(30)).otherwise(F.greatest(F.lit(1), F.coalesce(custom.try_cast("int"), F.lit(30))))
    return F.when(interval == "daily", 1).when(interval == "weekly", 7).when(interval == "monthly", 30).when(interval == "yearly", 365).otherwise(days)


def next_after(anchor: Column, days: Column) -> Column:
    return anchor + F.make_dt_interval(days)


def next_calendar(anchor: Column, interval: str, zone: str = "UTC", clock: str = "00:00", weekday: int = 0, month_day: int = 1, custom_days: int = 30) -> Column:
    """The next capture by wall clock in ``zone``, Monday 0; compared as local times, so changes of the
    clock don't move it. Other intervals add the custom days to the local date."""
    local = F.from_utc_timestamp(anchor, zone)
    day = F.to_date(local)
    at = lambda d: F.to_timestamp(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(f" {clock}:00")))
    if interval == "daily":
        found = F.when(at(day) > local, at(day)).otherwise(at(F.date_add(day, 1)))
    elif interval == "weekly":
        first = F.date_add(day, F.pmod(F.lit(max(0, min(6, weekday))) - F.weekday(day), F.lit(7)))
        found = F.when(at(first) > local, at(first)).otherwise(at(F.date_add(first, 7)))
    elif interval == "monthly":
        in_month = lambda m: F.date_add(m, F.least(F.lit(max(1, min(31, month_day))), F.dayofmonth(F.last_day(m))) - 1)
        this = F.trunc(day, "month")
        found = F.when(at(in_month(this)) > local, at(in_month(this))).otherwise(at(in_month(F.add_months(this, 1))))
    else:
        found = at(F.date_add(day, max(1, custom_days)))
    return F.to_utc_timestamp(found, zone)


def compact_time(text: Column) -> Column:
    """A timestamp from its first 14 digits; null if they are none."""
    return F.when(F.length(text) >= 14, F.try_to_timestamp(F.substring(text, 1, 14), F.lit("yyyyMMddHHmmss")))


def sort_time(compact: Column, created: Column) -> Column:
    return F.coalesce(compact_time(compact), created, F.lit("0001-01-01 00:00:00").cast("timestamp"))


def display_date(compact: Column) -> Column:
    p = lambda a, n: F.substring(compact, a, n)
    return F.when(F.length(compact) >= 8, F.concat_ws("-", p(1, 4), p(5, 2), p(7, 2)))


def wire_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def valid_clock(text: Column) -> Column:
    return F.btrim(text).rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d\z")


def valid_zone(name: Column) -> Column:
    """Whether the time-zone database of this Python knows the name; a missing one means UTC."""
    known = sorted(zoneinfo.available_timezones())
    trimmed = F.btrim(F.coalesce(name, F.lit("")))
    return (trimmed == "") | trimmed.isin(known)


def window_open(now: Column, start: str | None, end: str | None, zone: str = "UTC") -> Column:
    """Whether the capture window is open: no ends, always; one end, never; equal ends, always; it may span midnight."""
    if not start and not end:
        return F.lit(True)
    if not start or not end:
        return F.lit(False)
    clock = F.date_format(F.from_utc_timestamp(now, zone), "HH:mm")
    if start == end:
        return F.lit(True)
    inside = (clock >= start, clock < end)
    return inside[0] & inside[1] if start < end else inside[0] | inside[1]


def in_days(t: Column, first: Column, last: Column) -> Column:
    """Half-open: from the first day to the end of the last; a missing end is open."""
    return (first.isNull() | (t >= first)) & (last.isNull() | (t < F.date_add(last, 1)))
