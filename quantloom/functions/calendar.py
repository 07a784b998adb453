"""Whole-day arithmetic on TIMESTAMP_NTZ columns.

Everything works on wall-clock values, so neither the session time zone nor daylight saving can shift a step.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _time_of_day(ts: Column) -> Column:
    return ts - F.to_date(ts).cast("timestamp_ntz")


def _anchor_time(anchor: datetime) -> Column:
    return F.lit(timedelta(hours=anchor.hour, minutes=anchor.minute, seconds=anchor.second,
                           microseconds=anchor.microsecond))


def day_index(ts: Column, anchor: datetime) -> Column:
    """Calendar days from the anchor's date to the date of ``ts``."""
    return F.datediff(F.to_date(ts), F.lit(anchor.date()))


def ceil_day_index(ts: Column, anchor: datetime) -> Column:
    """Smallest whole d with ``anchor + d days >= ts``."""
    return day_index(ts, anchor) + (_time_of_day(ts) > _anchor_time(anchor)).cast("int")


def on_schedule(ts: Column, anchor: datetime, every: Column) -> Column:
    """True where ``ts`` is exactly the anchor plus a multiple of ``every`` days."""
    return (day_index(ts, anchor) % every == 0) & (_time_of_day(ts) == _anchor_time(anchor))


def plus_days(start: Column | datetime, days: Column) -> Column:
    """``start`` plus whole days, time of day kept."""
    begin = F.lit(start).cast("timestamp_ntz") if isinstance(start, datetime) else start
    return begin + F.make_dt_interval(days)


def chunk_of(ts: Column, chunk_days: int) -> Column:
    """Number of the fixed-length calendar chunk that holds ``ts``."""
    return F.floor(F.unix_date(F.to_date(ts)) / F.lit(chunk_days)).cast("int")
