"""Timestamp helpers. Exact time is kept as microseconds (``ts_us``), never as a float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(text) -> Column:
    """ISO-8601 text with offset, fraction of any length optional; a missing value is an error."""
    text = _col(text)
    return F.when(text.isNull(), F.raise_error(F.lit("missing timestamp")).cast("timestamp")).otherwise(
        text.cast("timestamp")
    )


def micros(ts) -> Column:
    """Microseconds since the epoch; a timestamp without zone is read as UTC (the session zone)."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def shift_minutes(ts, minutes: int) -> Column:
    return _col(ts) + F.make_interval(mins=F.lit(minutes))


def duration_ms(start, end) -> Column:
    return F.abs(micros(start) - micros(end)) / F.lit(1000.0)


def floor_minutes(ts, minutes: int) -> Column:
    """Minute floored to a multiple of ``minutes`` within its hour, seconds cleared."""
    ts = _col(ts).cast("timestamp")
    return F.date_trunc("hour", ts) + F.make_interval(mins=F.minute(ts) - F.minute(ts) % F.lit(minutes))


def epoch_bucket(ts_us, seconds: int = 900) -> Column:
    """Start (epoch seconds) of the bucket holding ``ts_us``."""
    ts_us, width = _col(ts_us), seconds * 1_000_000
    return ((ts_us - F.pmod(ts_us, F.lit(width))) / F.lit(1_000_000)).cast("long")


def floor_us(ts_us, width_us: int) -> Column:
    ts_us = _col(ts_us)
    return ts_us - F.pmod(ts_us, F.lit(width_us))
