"""Date and numeric helpers of the price API."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(c) -> Column:
    """``round(x*100)/100`` with half away from zero; NULL stays NULL.

    Not ``round(x, 2)``: for 1.005 that gives 1.0 where the reference gives 1.01.
    """
    return F.round(_c(c).cast("double") * F.lit(100.0), 0) / F.lit(100.0)


def date_text(c) -> Column:
    """``to_char(d, 'YYYY-MM-DD')``."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def period_label(c, group_by: str) -> Column:
    """Day ``YYYY-MM-DD``; week = Monday's date; month ``YYYY-MM``."""
    if group_by == "day":
        return date_text(c)
    if group_by == "week":
        return F.date_format(F.trunc(_c(c), "week"), "yyyy-MM-dd")
    if group_by == "month":
        return F.date_format(_c(c), "yyyy-MM")
    raise ValueError("group_by must be day|week|month")


def calendar_shift(c, years: int = 0, months: int = 0, days: int = 0) -> Column:
    """Go ``AddDate`` arithmetic: the day overflows into the next month
    (31 Mar - 1 month = 3 Mar), unlike ``add_months`` which clamps."""
    total = years * 12 + months
    first = F.add_months(F.trunc(_c(c), "MM"), total)
    return F.date_add(F.date_add(first, F.dayofmonth(_c(c)) - 1), days)


def add_date(d: _dt.date, years: int = 0, months: int = 0, days: int = 0) -> _dt.date:
    """S9 on a Python date (for parameters); same overflow rule as the column form."""
    m0 = d.year * 12 + (d.month - 1) + years * 12 + months
    first = _dt.date(m0 // 12, m0 % 12 + 1, 1)
    return first + _dt.timedelta(days=d.day - 1 + days)


def recent_from(as_of: _dt.date, window_days: int = 31) -> _dt.date:
    """Default lower bound ``as_of - 31 days``; ``as_of`` replaces the clock."""
    return as_of - _dt.timedelta(days=window_days)


def ntz_as_utc_instant(c: str) -> Column:
    """TIMESTAMP_NTZ wall time read as UTC -> TIMESTAMP (an instant), with no
    dependence on the session time zone (watermarks need TIMESTAMP)."""
    return F.timestamp_micros(
        F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})"))


def instant_as_utc_ntz(c: str) -> Column:
    """TIMESTAMP instant -> its UTC wall time as TIMESTAMP_NTZ."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
