"""Durations in microseconds and instants. Division is toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR, MINUTE, SECOND, MILLI = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000


def whole(us: Column, unit: int) -> Column:
    """How many whole units, as a long."""
    return F.call_function("div", us, F.lit(unit))


def in_days(us: Column) -> Column:
    """TIM-1 (I)."""
    return whole(us, DAY).cast("int")


def in_hours(us: Column) -> Column:
    """TIM-1 (I)."""
    return whole(us, HOUR).cast("int")


def in_minutes(us: Column) -> Column:
    """TIM-1 (I)."""
    return whole(us, MINUTE).cast("int")


def in_seconds(us: Column) -> Column:
    """TIM-3 (I)."""
    return whole(us, SECOND)


def in_milliseconds(us: Column) -> Column:
    """TIM-3 (I)."""
    return whole(us, MILLI)


def in_microseconds(us: Column) -> Column:
    """TIM-3 (I)."""
    return us.cast("long")


def in_seconds_f(us: Column) -> Column:
    """TIM-2 (I)."""
    return us.cast("double") / float(SECOND)


def in_milliseconds_f(us: Column) -> Column:
    """TIM-2 (I)."""
    return us.cast("double") / float(MILLI)


def in_milliseconds_up(us: Column) -> Column:
    """TIM-4 (I): a begun millisecond counts."""
    return whole(us + 999, MILLI)


def from_time_t(seconds: Column) -> Column:
    """TIM-5 (I): an instant; 0 means there is none."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0)))


def to_time_t(ts: Column) -> Column:
    """TIM-5 (I): whole seconds; 0 for none."""
    return F.coalesce(F.unix_seconds(ts), F.lit(0).cast("long"))


def from_double_t(seconds: Column) -> Column:
    """TIM-6 (I): 0 is the epoch here."""
    return F.timestamp_micros((seconds * SECOND).cast("long"))


def to_double_t(ts: Column) -> Column:
    """TIM-6 (I): seconds; 0 for none."""
    return F.coalesce(F.unix_micros(ts) / F.lit(float(SECOND)), F.lit(0.0))


def local_midnight(ts: Column) -> Column:
    """TIM-7 (I): the start of the day in the session's zone."""
    return F.date_trunc("DAY", ts)


#: TIM-8: formats in the order in which they are tried. Fixed values.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd MMM yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy")


def from_string(s: Column) -> Column:
    """TIM-8 (I; formats X): null for what no format reads. Day names are not checked."""
    text = F.regexp_replace(F.trim(s), "^[A-Za-z]{3}, ", "")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS))


def now_ms() -> Column:
    """TIM-9 (H)."""
    return F.unix_millis(F.current_timestamp())
