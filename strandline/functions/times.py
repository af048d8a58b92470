"""Time: instants with their own zone, calendar windows, intervals.

A record's time is an instant (``ts``, TIMESTAMP) beside the zone that it was
written in (``tz``, an offset such as ``-04:00`` or a region). Differences are
taken in whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("second", "minute", "hour", "day", "week", "month", "year")
#: Length in milliseconds of the units that have one.
FIXED_MS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def ms(ts: Column | str) -> Column:
    """Epoch milliseconds; finer digits are cut off."""
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


def local(ts: Column | str, tz: Column | str) -> Column:
    """Wall-clock time in the record's zone."""
    return F.from_utc_timestamp(ts, F.col(tz) if isinstance(tz, str) else tz)


def parse_iso(text: Column | str) -> tuple[Column, Column]:
    """(instant, zone) of an ISO-8601 time; the offset is kept, Z is +00:00, empty text is null."""
    text = F.col(text) if isinstance(text, str) else text
    offset = F.regexp_extract(text, r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    zone = F.when(offset == "Z", F.lit("+00:00")).when(offset != "", offset)
    return F.try_to_timestamp(F.when(F.trim(text) != "", text)), zone


def print_iso(ts: Column | str, tz: Column | str) -> Column:
    tz = F.col(tz) if isinstance(tz, str) else tz
    return F.concat(F.date_format(local(ts, tz), "yyyy-MM-dd'T'HH:mm:ss.SSS"), tz)


def window_begin(wall: Column, unit: str, *, compat_epoch: bool = False, tz: Column | None = None) -> Column:
    """Begin, in wall-clock time, of the calendar window of one ``unit`` that holds ``wall``.

    Weeks begin on Thursdays, as whole weeks since 1970-01-01. With
    ``compat_epoch`` weeks, months and years count from the local date of the
    Unix epoch, which is 1969-12-31 west of Greenwich.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    if unit in ("second", "minute", "hour", "day"):
        return F.date_trunc(unit, wall)
    epoch = F.to_date(local(F.lit("1970-01-01 00:00:00").cast("timestamp"), tz)) if compat_epoch and tz is not None else F.lit("1970-01-01").cast("date")
    date = F.to_date(wall)
    if unit == "week":
        return F.date_add(epoch, (F.floor(F.datediff(date, epoch) / 7) * 7).cast("int")).cast("timestamp")
    months = F.floor(F.months_between(date, epoch)).cast("int")
    if unit == "year":
        months = (F.floor(months / 12) * 12).cast("int")
    return F.add_months(epoch, months).cast("timestamp")


def window_end(begin: Column, unit: str) -> Column:
    """The window's last millisecond."""
    after = {"month": F.add_months(begin, 1).cast("timestamp"), "year": F.add_months(begin, 12).cast("timestamp")}.get(unit)
    return F.timestamp_millis(F.unix_millis(after) - 1) if after is not None else F.timestamp_millis(F.unix_millis(begin) + FIXED_MS[unit] - 1)


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Milliseconds that two intervals share, 0 if none."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
