"""Clocks, elapsed units, calendars and due dates as Column expressions."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, functions as F

# The logs keep epoch seconds one hour ahead of the report clock.
REPORT_SHIFT = -3600


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# --- clocks ------------------------------------------------------------------

def event_epoch(actual, ctime=None) -> Column:
    """Epoch second an event counts for.

    With a create time the earlier of both clocks is used; when either one is
    missing the create time decides (so a missing create time gives NULL).
    ``least`` would skip NULLs and is therefore not used.
    """
    actual = _c(actual)
    if ctime is None:
        return actual
    ctime = _c(ctime)
    return F.when(ctime > actual, actual).otherwise(ctime)


def from_epoch(seconds, shift: int = 0) -> Column:
    return F.timestamp_seconds(_c(seconds) + F.lit(shift))


def epoch_between(seconds, first: str, last: str, shift: int = 0) -> Column:
    """True where ``from_epoch(seconds, shift)`` falls on a day from ``first`` to ``last``.

    Stated on the stored column with constants, so that a scan can skip row groups.
    """
    start, end = (calendar.timegm(dt.date.fromisoformat(str(d)).timetuple()) for d in (first, last))
    return (_c(seconds) >= start - shift) & (_c(seconds) < end + 86_400 - shift)


def months_before(as_of: dt.date, months: int, whole: bool = False) -> dt.date:
    """The same day ``months`` months earlier, or the last of a shorter month; ``whole`` counts from the first of the month."""
    at = as_of.year * 12 + as_of.month - 1 - months
    year, month = divmod(at, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return dt.date(year, month + 1, 1 if whole else min(as_of.day, last))


def epoch_from(seconds, first: dt.date, shift: int = 0) -> Column:
    """True where ``from_epoch(seconds, shift)`` falls on ``first`` or later, stated on the stored column."""
    return _c(seconds) >= calendar.timegm(first.timetuple()) - shift


def event_time(actual, ctime=None, shift: int = REPORT_SHIFT) -> Column:
    return from_epoch(event_epoch(actual, ctime), shift)


def to_epoch(ts) -> Column:
    """Epoch seconds as double, keeping the fraction."""
    return F.unix_micros(_c(ts)) / F.lit(1e6)


# --- parts and labels --------------------------------------------------------

def iso_dow(ts) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(_c(ts)) + F.lit(1)


def is_sunday(ts) -> Column:
    return iso_dow(ts) == 7


def day(ts) -> Column:
    return F.to_date(_c(ts))


def iso_week(ts) -> Column:
    return F.weekofyear(_c(ts))


def month_label(ts) -> Column:
    """``M/YYYY``."""
    ts = _c(ts)
    return F.concat(F.month(ts).cast("string"), F.lit("/"), F.year(ts).cast("string"))


def period_start(ts, grain: str) -> Column:
    """First day of the week (Monday) or month as DATE; the day itself for 'day'."""
    return F.date_trunc(grain, _c(ts)).cast("date")


def period_number(ts, grain: str) -> Column:
    """ISO week or month number; these merge years, see :func:`period_start`."""
    return {"week": iso_week, "month": lambda t: F.month(_c(t)), "day": day}[grain](ts)


# --- elapsed units -----------------------------------------------------------

def elapsed(unit: str, start, end) -> Column:
    """Whole units that have fully passed (not calendar boundaries crossed)."""
    return F.timestamp_diff(unit.upper(), _c(start), _c(end))


def elapsed_days_real(start, end) -> Column:
    """Days between two instants as double, from whole seconds."""
    return elapsed("second", start, end).cast("double") / F.lit(3600) / F.lit(24)


def gap_days(start, end, digits: int = 3) -> Column:
    return F.round((to_epoch(end) - to_epoch(start)) / F.lit(86400), digits)


def leadtime_days(start, end) -> Column:
    """Elapsed hours in whole days (integer division), as double."""
    hours = elapsed("hour", start, end)
    return F.when(hours >= 0, F.floor(hours / 24)).otherwise(F.ceil(hours / 24)).cast("double")


def round_half_up(x) -> Column:
    """Nearest whole number, halves upwards, as bigint."""
    return F.floor(_c(x) + F.lit(0.5))


# --- calendar rules ----------------------------------------------------------

def sundays_between(start, end) -> Column:
    """Sundays that do not count against the carrier, as double.

    Under seven elapsed days one Sunday counts when the weekday went round or
    the end is a Sunday.  From seven days on it is the number of whole weeks,
    less one for each end that is a Sunday unless both are.  NULL ends give 0.
    """
    start, end = _c(start), _c(end)
    days, weeks = elapsed("day", start, end), elapsed("week", start, end)
    start_dow, end_dow = iso_dow(start), iso_dow(end)
    end_sun, start_sun = end_dow == 7, start_dow == 7
    within_week = (days < 7) & ((end_dow < start_dow) | end_sun)
    rule = (
        F.when(within_week, F.lit(1))
        .when((days >= 7) & end_sun & start_sun, weeks)
        .otherwise(weeks - end_sun.cast("int") - start_sun.cast("int"))
    )
    return F.coalesce(rule, F.lit(0)).cast("double")


def due_date(pickup, allowance_days) -> Column:
    """Pickup instant plus the allowance rounded to whole days (halves up)."""
    return F.timestamp_seconds(to_epoch(pickup) + round_half_up(allowance_days) * 86400)


def due_date_midnight(pickup, allowance_days) -> Column:
    """Midnight that ends the due day."""
    return F.date_add(due_date(pickup, allowance_days).cast("date"), 1).cast("timestamp")


def noon_adjust(ts) -> Column:
    """Before noon the clock starts at 12:00, otherwise at the next midnight."""
    ts = _c(ts)
    midnight = F.date_trunc("day", ts)
    return F.when(F.hour(ts) < 12, midnight + F.expr("INTERVAL 12 HOURS")).otherwise(
        midnight + F.expr("INTERVAL 1 DAY")
    )


def weekend_allowance(ts, sla, divisor: float = 7.1) -> Column:
    """Weekends a lead time of ``sla`` days crosses when it starts at ``ts``."""
    ts = _c(ts)
    start = iso_dow(ts).cast("double") + F.hour(ts).cast("double") / 24
    return F.floor((start + _c(sla)) / F.lit(divisor)).cast("double")


def is_set(epoch, shift: int = 0) -> Column:
    """Epoch 0 (year 1970) means that a schedule was never set."""
    return F.year(from_epoch(epoch, shift)) > 1970


def is_unset(epoch, shift: int = 0) -> Column:
    """Zero, also after the shift of the report clock has moved it before 1970."""
    return F.year(from_epoch(epoch, shift)) <= 1970
