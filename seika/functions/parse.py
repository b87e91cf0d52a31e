"""Text-to-value parsing of raw CSV fields.

Every parser returns a pair of columns: the value and an ``ok`` flag, so that a
bad field is a reject reason rather than a silent NULL. Only ``try_*`` casts are
used: raw input is dirty and ANSI mode is on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seika.functions.text import trim_unicode

# Fixed value: the decimal float syntax accepted (a narrowing of Go's
# ParseFloat: NaN, Inf and hex floats are rejected, see README).
FLOAT_SYNTAX = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INT_SYNTAX = r"^[+-]?[0-9]+$"
INT32_MIN, INT32_MAX = -(2 ** 31), 2 ** 31 - 1


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_required_int(c, trim: bool = True):
    """S3: signed base-10 integer; blank or anything else is an error.

    Returns (value BIGINT, ok BOOLEAN). ``trim=False`` when ``c`` is already trimmed.
    """
    s = trim_unicode(c) if trim else _c(c)
    v = F.when(s.rlike(INT_SYNTAX), s.try_cast("bigint"))
    return v, v.isNotNull()


def nullable_number_text(c, trim: bool = True) -> Column:
    """Trim; '' and '-' mean NULL; thousands commas dropped."""
    s = trim_unicode(c) if trim else _c(c)
    return F.when(~s.isin("", "-"), F.replace(s, F.lit(","), F.lit("")))


def parse_nullable_float(c, prepared: bool = False):
    """S4: ''/'-' is NULL, commas dropped, decimal float syntax.

    Returns (value DOUBLE, ok BOOLEAN); ok is true for NULL. ``prepared=True``
    when ``c`` already went through ``nullable_number_text``.
    """
    s = _c(c) if prepared else nullable_number_text(c)
    raw = float_candidate(s)
    return checked_float(raw), s.isNull() | checked_float(raw).isNotNull()


def float_candidate(s: Column) -> Column:
    """The double of a number text that has the accepted syntax, else NULL
    (may be infinite: checked by ``checked_float``)."""
    return F.when(s.rlike(FLOAT_SYNTAX), s.try_cast("double"))


def checked_float(raw: Column) -> Column:
    """An out-of-range literal like 1e400 is an error in Go (ErrRange)."""
    return F.when(F.abs(raw) <= F.lit(1.7976931348623157e308), raw)


def parse_nullable_int(c, prepared: bool = False):
    """As S4, integer first, else float truncated toward zero (12.9 -> 12, -0.4 -> 0).

    Returns (value BIGINT, ok BOOLEAN). The value is 64-bit; whether it fits
    the stored INT is a load concern (I11), not a parse error.
    """
    s = _c(c) if prepared else nullable_number_text(c)
    v = int_candidate(s)
    return v, s.isNull() | v.isNotNull()


def int_candidate(s: Column) -> Column:
    """S5 value of a number text: base-10 integer, else a float truncated
    toward zero; NULL when neither parses."""
    as_int = F.when(s.rlike(INT_SYNTAX), s.try_cast("bigint"))
    f = F.when(~s.rlike(INT_SYNTAX) & s.rlike(FLOAT_SYNTAX), s.try_cast("double"))
    truncated = F.when(F.abs(f) < F.lit(9.2e18),
                       F.when(f >= 0, F.floor(f)).otherwise(F.ceil(f)).cast("bigint"))
    return F.coalesce(as_int, truncated)


def days_in_month(y: Column, m: Column) -> Column:
    """Gregorian month length (February 29 in leap years)."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return (F.when(m == 2, F.when(leap, 29).otherwise(28))
             .when(m.isin(4, 6, 9, 11), 30).otherwise(31))


def parse_trade_date(year, month, day) -> Column:
    """Year with exactly four digits, month 1-12, valid day of that month; else NULL.

    The calendar check is arithmetic, so ``make_date`` (which raises under
    ANSI mode) only ever sees a valid date; no text round trip."""
    y, m, d = _c(year), _c(month), _c(day)
    valid = y.between(1000, 9999) & m.between(1, 12) & d.between(1, 31)
    valid = valid & (d <= days_in_month(y, m))
    return F.when(valid, F.make_date(y.cast("int"), m.cast("int"), d.cast("int")))


def to_decimal_14_3(v) -> Column:
    """DOUBLE -> DECIMAL(14,3), half-up; NULL on overflow (the caller flags it)."""
    return _c(v).try_cast("decimal(14,3)")


def int32_overflow(v) -> Column:
    """True when a parsed integer does not fit the stored INT column."""
    return _c(v).isNotNull() & ~_c(v).between(INT32_MIN, INT32_MAX)
