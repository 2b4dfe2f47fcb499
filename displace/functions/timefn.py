"""Dates, float years and repaired time strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_to_time(key: Column) -> Column:
    """An acquisition column's name as a timestamp: date_yyyyMMdd, yyyyMMdd, or an old epoch number counted in 6 days from 2015-04-07 (20150)."""
    digits = F.regexp_extract(key, r"^(?:date_)?(\d{8})$", 1)
    old = F.regexp_extract(key, r"^.{5}(\d{5})$", 1)
    day = F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd"))
    return F.coalesce(day.cast("timestamp_ntz"), F.date_add(F.lit("2015-04-07").cast("date"), (F.nullif(old, F.lit("")).try_cast("int") - 20150) * 6).cast("timestamp_ntz"))


def float_year(t: Column) -> Column:
    """Year plus whole days since 1 January over 365.25."""
    return F.year(t) + (F.dayofyear(t) - 1) / 365.25


def from_float_year(y: Column) -> Column:
    """The timestamp of a float year, to the second."""
    seconds = F.round((y - F.floor(y)) * 365.25 * 86400).cast("long")
    return F.timestamp_add("SECOND", seconds.cast("int"), F.make_date(F.floor(y).cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz"))


def gps_week(week: Column) -> Column:
    return F.date_add(F.lit("1980-01-06").cast("date"), (week * 7).cast("int")).cast("timestamp_ntz")


def time_repair(t: Column) -> Column:
    """Time strings as HH:mm:ss.f: padded hours, a fraction added, null as midnight; anything else is blank."""
    padded = F.when(t.rlike(r"^\d:"), F.concat(F.lit("0"), t)).otherwise(t)
    whole = F.when(padded.rlike(r"^\d\d:\d\d$"), F.concat(padded, F.lit(":00.0"))).when(padded.rlike(r"^\d\d:\d\d:\d\d$"), F.concat(padded, F.lit(".0"))).when(padded.rlike(r"^\d\d:\d\d:\d\d\.\d+$"), padded)
    return F.when(t.isNull(), F.lit("00:00:00.0")).otherwise(F.coalesce(whole, F.lit("")))


def time_is_wrong(t: Column) -> Column:
    """More than one point, more than two colons, or 60 seconds and more."""
    seconds = F.nullif(F.regexp_extract(t, r"^\d+:\d+:(\d+)", 1), F.lit("")).try_cast("int")
    return (F.regexp_count(t, F.lit(r"\.")) > 1) | (F.regexp_count(t, F.lit(":")) > 2) | (F.coalesce(seconds, F.lit(0)) >= 60)


def peak_date(phase: Column, cycle_days: float = 365.0) -> Column:
    """The day and month, from 1 January 2015, where a phase (radians of a cycle) lies."""
    turn = 6.283185307179586
    return F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), F.floor(phase / turn * cycle_days).cast("int")), "dd.MM.")
