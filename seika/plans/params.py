"""Request parameters of the analytic queries.

Parameters are plain Python values checked on the driver before any plan is
built; bad input raises ``ValueError`` (the reference answers HTTP 400).
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seika.functions.dates import recent_from

# API guards.
DEFAULT_RECENT_DAYS = 31
MAX_DATE_RANGE_DAYS = 366
MAX_CODE_LENGTH = 32
MAX_SEARCH_LENGTH = 100

_ISO_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
_INT = re.compile(r"^[+-]?\d+$")


def text(v) -> str:
    """Blank-safe trimmed text of a parameter (None -> '')."""
    return "" if v is None else str(v).strip()


def parse_int_or_default(v, default: int) -> int:
    """A non-integer (or missing) value gives the default."""
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    s = text(v)
    return int(s) if _INT.match(s) else default


def clamp(v: int, lo: int, hi: int) -> int:
    return max(lo, min(hi, v))


def parse_limit(v, default: int, hi: int) -> int:
    return clamp(parse_int_or_default(v, default), 1, hi)


def parse_offset(v) -> int:
    return max(parse_int_or_default(v, 0), 0)


def parse_order(v) -> str:
    """Only 'asc' (any case) is ascending; anything else is descending."""
    return "asc" if text(v).lower() == "asc" else "desc"


def parse_date(v, field: str) -> _dt.date:
    """Strict ``YYYY-MM-DD`` (two-digit month and day, real calendar date)."""
    s = text(v)
    if isinstance(v, _dt.date):
        return v
    if not _ISO_DATE.match(s):
        raise ValueError(f"{field}: not a date like 1998-12-31")
    try:
        return _dt.date.fromisoformat(s)
    except ValueError:
        raise ValueError(f"{field}: not a date like 1998-12-31") from None


def validate_code(field: str, v: str) -> str:
    """Codes are limited to 32 bytes (UTF-8 length, as the reference measures it)."""
    if len(v.encode("utf-8")) > MAX_CODE_LENGTH:
        raise ValueError(f"{field}: more than {MAX_CODE_LENGTH} bytes")
    return v


def validate_search(q: str) -> str:
    if len(q.encode("utf-8")) > MAX_SEARCH_LENGTH:
        raise ValueError(f"q: more than {MAX_SEARCH_LENGTH} bytes")
    return q


def require(**named) -> None:
    missing = [k for k, v in named.items() if text(v) == ""]
    if missing:
        raise ValueError("needed but not given: " + ", ".join(missing))


@dataclass
class DateFilter:
    """The trade-date predicate of a price query and its default window."""
    predicate: Column | None
    default_from: _dt.date | None
    date: _dt.date | None = None
    from_: _dt.date | None = None
    to: _dt.date | None = None


def date_filter(date=None, from_=None, to=None, as_of: _dt.date | None = None,
                include_single_date: bool = True, full_history: bool = False,
                column: str = "trade_date") -> DateFilter:
    """``date =``, ``from >=``, ``to <=``.

    Both bounds given: ``to >= from`` and at most 366 days apart. With none of
    the three given the window is ``[as_of - 31 days, ...)`` (S13), unless
    ``full_history`` asks for the whole table. ``date`` is only accepted where
    the query filters on it (``include_single_date``); elsewhere it is
    rejected instead of silently widening the scan (a deliberate difference).
    """
    c = F.col(column)
    preds = []
    d = f = t = None
    if text(date):
        if not include_single_date:
            raise ValueError("date is not supported for this query; use from/to")
        d = parse_date(date, "date")
        preds.append(c == F.lit(d))
    if text(from_):
        f = parse_date(from_, "from")
        preds.append(c >= F.lit(f))
    if text(to):
        t = parse_date(to, "to")
        preds.append(c <= F.lit(t))
    if f is not None and t is not None:
        if t < f:
            raise ValueError("the range ends before it begins")
        if (t - f).days > MAX_DATE_RANGE_DAYS:
            raise ValueError(f"a range may span {MAX_DATE_RANGE_DAYS} days at most")
    default_from = None
    if d is None and f is None and t is None and not full_history:
        if as_of is None:
            as_of = _dt.date.today()
        default_from = recent_from(as_of, DEFAULT_RECENT_DAYS)
        preds.append(c >= F.lit(default_from))
    pred = None
    for p in preds:
        pred = p if pred is None else (pred & p)
    return DateFilter(pred, default_from, d, f, t)


def result_meta(**kv) -> dict:
    """The metadata returned next to a result (limit, offset, total, metric,
    group_by, latest_trade_date, default_from, default_window_days). Values that
    need a Spark action are passed as zero-argument callables and evaluated by
    ``resolve_meta`` only when asked for."""
    meta = {k: v for k, v in kv.items() if v is not None or k in ("latest_trade_date",)}
    if meta.get("default_from") is not None:
        meta["default_from"] = str(meta["default_from"])
        meta["default_window_days"] = DEFAULT_RECENT_DAYS
    return meta


def resolve_meta(meta: dict) -> dict:
    return {k: (v() if callable(v) else v) for k, v in meta.items()}


class SeenTotal:
    """A total that is counted while the result's own action runs (``DataFrame.observe``): ``watch`` marks the rows
    to count, ``seen`` gives their number after the action. Calling it counts them in a pass of its own."""

    def __init__(self, df: DataFrame):
        self._df, self._seen = df, Observation()

    def watch(self) -> DataFrame:
        return self._df.observe(self._seen, F.count(F.lit(1)).alias("n"))

    def seen(self) -> int:
        return self._seen.get["n"]

    def __call__(self) -> int:
        return self._df.count()


def answer(result: DataFrame, meta: dict) -> tuple[list, dict]:
    """The rows of a page or an aggregate (bounded by the query's own limit or its keys) and its metadata, by
    one action: totals before paging are observed, other totals are the rows' number, and the latest
    date and its total stand in the rows. Nothing is scanned a second time."""
    rows = result.collect()
    out = dict(meta)
    for name, value in meta.items():
        if isinstance(value, SeenTotal):
            out[name] = value.seen()
        elif name == "latest_trade_date":
            out[name] = rows[0]["trade_date"] if rows else None
        elif name == "total":
            out[name] = len(rows) if "total_count" not in result.columns else rows[0]["total_count"] if rows else 0
    return rows, out
