"""The analytic price queries.

Each function takes the warehouse (``seika.schemas.Star``) and the request
parameters, checks the parameters on the driver (``ValueError`` for bad
input), and returns ``(DataFrame, meta)``. Nothing is collected: the page,
aggregate or ranking is a lazy plan.

Plan shape, shared by all queries: the fact table is filtered on codes and
dates first (pushed to the Parquet scan), aggregated or cut to a page
*before* dimension names are attached, and only the small result is joined
to the dimensions. Sort orders spell out PostgreSQL's null placement
(ASC nulls last, DESC nulls first) since Spark's defaults are the opposite.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seika.functions.dates import add_date, date_text, period_label, round2
from seika.functions.text import like_search
from seika.plans import params as P
from seika.schemas import CODE_DIMS, Star

# Sort keys accepted by the daily/latest queries -> fact column.
DAILY_SORT = {
    "trade_date": "trade_date", "market_code": "market_code", "item_code": "item_code",
    "origin_code": "origin_code", "price_mid": "price_mid_yen", "arrival": "arrival_ton",
}
# The 20 columns of a daily price row, in output order.
DAILY_COLUMNS = [
    "trade_date", "weekday_ja", "market_code", "market_name", "item_code", "item_name",
    "origin_code", "origin_name", "grade", "class", "product_name", "unit_weight",
    "item_total_ton", "arrival_ton", "price_high_yen", "price_mid_yen", "price_low_yen",
    "trend_label", "source_file", "source_row_no",
]
# Preset trend windows as (years, months, days) added to as_of.
TREND_PRESETS = {"1m": (0, -1, 0), "6m": (0, -6, 0), "1y": (-1, 0, 0)}


def pg_order(col: str | Column, order: str) -> Column:
    """PostgreSQL's default null placement for ``ORDER BY col ASC|DESC``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.asc_nulls_last() if order == "asc" else c.desc_nulls_first()


def nulls_last(col: str | Column, order: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.asc_nulls_last() if order == "asc" else c.desc_nulls_last()


def _code_filters(fact: DataFrame, item_code=None, market_code=None, origin_code=None) -> DataFrame:
    """R3 on the fact: a code that is not in the data simply selects nothing
    (the reference answers an empty 200), since fact codes are foreign keys."""
    for col, v in (("item_code", item_code), ("market_code", market_code), ("origin_code", origin_code)):
        if P.text(v):
            fact = fact.where(F.col(col) == F.lit(P.text(v)))
    return fact


def _where(df: DataFrame, pred: Column | None) -> DataFrame:
    return df if pred is None else df.where(pred)


def fact_between(star: Star, lo: _dt.date | None = None, hi: _dt.date | None = None) -> DataFrame:
    """The fact table, of a stored warehouse only the months (partitions) whose
    trade dates, as stored, reach into ``[lo, hi]``. The date predicate
    itself stays the caller's."""
    months = star.extra.get("months")
    if months is None or (lo is None and hi is None):
        return star.fact
    need = [m for m, (first, last) in sorted(months.items()) if (lo is None or last >= lo) and (hi is None or first <= hi)]
    return star.fact.where(F.col("load_month").isin(need) if need else F.lit(False))


def _fact_for(star: Star, f) -> DataFrame:
    """``fact_between`` for the bounds of a ``DateFilter``."""
    return fact_between(star, f.date or f.from_ or f.default_from, f.date or f.to)


def _with_names(df: DataFrame, star: Star, kinds=("market", "item", "origin"),
                bounded: bool = False) -> DataFrame:
    """Attach dimension names to a small result by code (inner join, as the
    reference's join to its dimensions). ``bounded`` states that ``df`` is a
    page or top-k (at most ``limit`` rows, limit <= 2000): it is then broadcast
    and the dimension streamed, so a large dimension is never shuffled for a
    page. Otherwise the planner picks the side from its size statistics."""
    if bounded:
        df = F.broadcast(df)
    for kind in kinds:
        code, name = CODE_DIMS[kind]
        df = df.join(star.dim(kind).select(code, name), on=code, how="inner")
    return df


def resolve_codes(star: Star, item_code=None, market_code=None, origin_code=None) -> DataFrame:
    """Code -> id for up to three dimensions, one row, or no row when any
    given code is unknown."""
    out = None
    for kind, v in (("item", item_code), ("market", market_code), ("origin", origin_code)):
        if not P.text(v):
            continue
        code, _ = CODE_DIMS[kind]
        one = star.dim(kind).where(F.col(code) == F.lit(P.text(v))).select(
            F.lit(1).alias("_k"), F.col("id").alias(f"{kind}_id"))
        out = one if out is None else out.join(one, "_k")
    if out is None:
        raise ValueError("missing required params: item_code")
    return out.drop("_k")


# ---------------------------------------------------------------- R5 / R6

def _daily_select(df: DataFrame) -> DataFrame:
    return df.select(
        date_text("trade_date").alias("trade_date"), "weekday_ja", "market_code", "market_name",
        "item_code", "item_name", "origin_code", "origin_name", "grade", "class", "product_name",
        "unit_weight", round2("item_total_ton").alias("item_total_ton"),
        round2("arrival_ton").alias("arrival_ton"), "price_high_yen", "price_mid_yen",
        "price_low_yen", "trend_label", "source_file", "source_row_no",
        *[c for c in df.columns if c == "total_count"])


def _page_order(sort, order) -> tuple[list[Column], str, str]:
    sort_col = DAILY_SORT.get(P.text(sort).lower(), "trade_date")
    o = P.parse_order(order)
    # one sort column in the reference; the source key makes pages stable
    return [pg_order(sort_col, o), F.col("source_file").asc(), F.col("source_row_no").asc()], sort_col, o


def prices_daily(star: Star, item_code, market_code=None, origin_code=None, date=None,
                 from_=None, to=None, sort=None, order=None, limit=None, offset=None,
                 as_of: _dt.date | None = None):
    """One page of daily rows of an item, newest first by default.

    The page is cut on the fact table (top-k with offset), then joined to the
    dimension names: at most ``limit`` rows reach the join.
    """
    P.require(item_code=item_code)
    lim, off = P.parse_limit(limit, 100, 2000), P.parse_offset(offset)
    keys, _, _ = _page_order(sort, order)
    df_ = P.date_filter(date, from_, to, as_of, include_single_date=True)
    fact = _where(_code_filters(_fact_for(star, df_), item_code, market_code, origin_code), df_.predicate)
    page = fact.orderBy(*keys).offset(off).limit(lim)
    out = _daily_select(_with_names(page, star, bounded=True).orderBy(*keys))
    return out, P.result_meta(limit=lim, offset=off, default_from=df_.default_from)


def prices_latest(star: Star, item_code, market_code=None, origin_code=None, sort=None,
                  order=None, limit=None, offset=None, date=None, from_=None, to=None):
    """Rows on the latest trade date of an item (optionally market/origin),
    with ``total_count`` = rows on that date before paging.

    Of a stored warehouse the latest date is looked up newest month first
    (``latest_date``), and the page and its total read only the months that hold
    it. Of other tables the date and its row count come from one scalar
    subquery over the filtered fact's per-date counts.
    """
    P.require(item_code=item_code)
    if any(P.text(v) for v in (date, from_, to)):
        raise ValueError("the latest prices take no date, from or to")
    for field, v in (("market_code", market_code), ("item_code", item_code), ("origin_code", origin_code)):
        if P.text(v):
            P.validate_code(field, P.text(v))
    lim, off = P.parse_limit(limit, 100, 2000), P.parse_offset(offset)
    keys, _, _ = _page_order(sort, order)
    codes = (item_code, market_code, origin_code)
    if star.extra.get("months") is not None:
        day = latest_date(star, *codes)
        on_latest = _code_filters(fact_between(star, day, day) if day else star.fact, *codes).where(F.col("trade_date") == F.lit(day))
        total = on_latest.agg(F.count(F.lit(1))).scalar()
    else:
        # one scalar subquery: rows per date (one row per calendar date), then the
        # newest date with its row count -> latest date and the total in one job
        fact = _code_filters(star.fact, *codes)
        per_day = fact.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
        last = per_day.agg(F.max_by(F.struct("trade_date", "n"), "trade_date").alias("l")).scalar()
        on_latest = fact.where(F.col("trade_date") == last.getField("trade_date"))
        total = last.getField("n")
    page = (on_latest.orderBy(*keys).offset(off).limit(lim)
            .withColumn("total_count", total))
    out = _daily_select(_with_names(page, star, bounded=True).orderBy(*keys))
    meta = P.result_meta(limit=lim, offset=off)
    meta["latest_trade_date"] = lambda: _first(on_latest.agg(date_text(F.max("trade_date"))))
    meta["total"] = lambda: (_first(out.select("total_count").limit(1)) or 0)
    return out, meta


def latest_date(star: Star, item_code=None, market_code=None, origin_code=None) -> _dt.date | None:
    """The latest trade date of rows with these codes in a stored warehouse, newest month first: one month is
    asked, then two more, four more and so on, until no month left could hold a later date. At most
    log2(months) small jobs, mostly one; each reads the months' dates and codes alone."""
    left = sorted(star.extra["months"].items(), key=lambda m: (m[1][1], m[0]), reverse=True)
    best, step = None, 1
    while left and (best is None or left[0][1][1] > best):
        months, left = [m for m, (_, last) in left[:step] if best is None or last > best], left[step:]
        found = _code_filters(star.fact.where(F.col("load_month").isin(months)), item_code, market_code, origin_code)
        day = _first(found.agg(F.max("trade_date")))
        best = max(filter(None, (best, day)), default=None)
        step *= 2
    return best


def _first(df: DataFrame):
    r = df.take(1)
    return r[0][0] if r else None


# ---------------------------------------------------------------- R7 / R8

def prices_trend(star: Star, item_code=None, market_code=None, origin_code=None, from_=None,
                 to=None, date=None, as_of: _dt.date | None = None, all_items: bool = False,
                 full_history: bool = False):
    """Per day ``COUNT(price_mid)``, AVG/MAX/MIN of price_mid and SUM of
    arrival, days without any price dropped, ascending.

    ``all_items=True`` serves every item in one job (grouped by item too).
    ``date`` is rejected (the reference ignores it but drops the default window).
    """
    if not all_items:
        P.require(item_code=item_code)
    df_ = P.date_filter(date, from_, to, as_of, include_single_date=False, full_history=full_history)
    fact = _where(_code_filters(_fact_for(star, df_), None if all_items else item_code, market_code, origin_code),
                  df_.predicate)
    keys = ["item_code", "trade_date"] if all_items else ["trade_date"]
    agg = (fact.groupBy(*keys)
               .agg(F.count("price_mid_yen").alias("rows_count"),
                    F.avg("price_mid_yen").alias("avg_price_mid_yen"),
                    F.max("price_mid_yen").alias("max_price_mid_yen"),
                    F.min("price_mid_yen").alias("min_price_mid_yen"),
                    F.sum("arrival_ton").cast("double").alias("arrival_ton_sum"))
               .where(F.col("rows_count") > 0)
               .orderBy(*keys))
    out = agg.select(*[k for k in keys if k != "trade_date"],
                     date_text("trade_date").alias("trade_date"), "rows_count",
                     round2("avg_price_mid_yen").alias("avg_price_mid_yen"),
                     "max_price_mid_yen", "min_price_mid_yen",
                     round2("arrival_ton_sum").alias("arrival_ton_sum"))
    meta = P.result_meta(default_from=df_.default_from)
    meta["total"] = lambda: out.count()
    return out, meta


def prices_trend_preset(star: Star, preset: str, as_of: _dt.date, item_code=None,
                        market_code=None, origin_code=None, all_items: bool = False):
    """R7 over ``[as_of + preset, as_of]`` with Go's calendar overflow (S9);
    any caller-given dates are replaced."""
    y, m, d = TREND_PRESETS[preset]
    start = add_date(as_of, y, m, d)
    return prices_trend(star, item_code, market_code, origin_code, from_=start.isoformat(),
                        to=as_of.isoformat(), as_of=as_of, all_items=all_items)


# ---------------------------------------------------------------- R9

def prices_summary(star: Star, item_code=None, group_by=None, market_code=None, origin_code=None,
                   from_=None, to=None, date=None, as_of: _dt.date | None = None,
                   all_items: bool = False, full_history: bool = False):
    """Per period (day / Monday-week / month) ``COUNT(*)`` (null prices
    included, no HAVING), AVG(price_mid), SUM(arrival)."""
    if not all_items:
        P.require(item_code=item_code)
    g = P.text(group_by).lower() or "day"
    period = period_label("trade_date", g)  # raises for a bad group_by
    df_ = P.date_filter(date, from_, to, as_of, include_single_date=False, full_history=full_history)
    fact = _where(_code_filters(_fact_for(star, df_), None if all_items else item_code, market_code, origin_code),
                  df_.predicate)
    keys = ["item_code", "period"] if all_items else ["period"]
    out = (fact.withColumn("period", period)
               .groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("rows_count"),
                    round2(F.avg("price_mid_yen")).alias("avg_price_mid_yen"),
                    round2(F.sum("arrival_ton").cast("double")).alias("arrival_ton_sum"))
               .orderBy(*keys))
    meta = P.result_meta(group_by=g, default_from=df_.default_from)
    meta["total"] = lambda: out.count()
    return out, meta


# ---------------------------------------------------------------- R10

def _metric(metric: str, allowed: tuple[str, ...]) -> str:
    m = P.text(metric).lower()
    if m not in allowed:
        raise ValueError("metric must be " + "|".join(allowed))
    return m


def compare_markets(star: Star, date, item_code=None, metric=None, order=None,
                    all_items: bool = False):
    """On one date, per market ``COUNT(*)`` and AVG(price_mid) or
    SUM(arrival); ordered by the metric (DESC, nulls first by default), then
    market code. Aggregated on codes first; names are joined to the result."""
    if all_items:
        P.require(date=date)
    else:
        P.require(date=date, item_code=item_code)
        P.validate_code("item_code", P.text(item_code))
    d = P.parse_date(date, "date")
    m = _metric(metric or "price_mid", ("price_mid", "arrival"))
    o = P.parse_order(order)
    fact = fact_between(star, d, d).where(F.col("trade_date") == F.lit(d))
    if not all_items:
        fact = _code_filters(fact, item_code)
    value = (F.avg("price_mid_yen") if m == "price_mid" else F.sum("arrival_ton")).cast("double")
    keys = ["item_code", "market_code"] if all_items else ["market_code"]
    agg = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_count"), value.alias("metric_value"))
    out = _with_names(agg, star, ("market",))
    sort = ([F.col("item_code").asc()] if all_items else []) + [pg_order("metric_value", o),
                                                                F.col("market_code").asc()]
    out = out.select(*keys[:-1], "market_code", "market_name", "rows_count",
                     round2("metric_value").alias("metric_value")).orderBy(*sort)
    meta = P.result_meta(metric=m)
    meta["total"] = lambda: out.count()
    return out, meta


# ---------------------------------------------------------------- R11

def rank_items(star: Star, date=None, metric=None, order=None, limit=None, market_code=None,
               all_dates: bool = False, from_=None, to=None):
    """On one date, per item ``COUNT(metric)`` and SUM(arrival) or
    AVG(price_mid), items without a value dropped, top ``limit`` by the metric
    (nulls last, ties by item code), then names joined.

    The top-k is cut before the dimension join (TakeOrderedAndProject), as the
    reference's CTE does. Item ids are assigned in code order, so the
    reference's tie on id is a tie on code here. ``all_dates=True`` ranks every
    date of ``[from_, to]`` in one job: per-date top-k by a window over the
    (date, item) aggregate, which holds one row per item and date.
    """
    m = _metric(metric or "arrival", ("arrival", "price_mid"))
    o = P.parse_order(order)
    lim = P.parse_limit(limit, 50, 500)
    if all_dates:
        df_ = P.date_filter(None, from_, to, full_history=not (from_ or to), include_single_date=False)
        fact = _where(_fact_for(star, df_), df_.predicate)
    else:
        P.require(date=date)
        d = P.parse_date(date, "date")
        fact = fact_between(star, d, d).where(F.col("trade_date") == F.lit(d))
    if P.text(market_code):
        P.validate_code("market_code", P.text(market_code))
        fact = _code_filters(fact, market_code=market_code)
    col = "arrival_ton" if m == "arrival" else "price_mid_yen"
    value = (F.sum(col) if m == "arrival" else F.avg(col)).cast("double")
    keys = ["trade_date", "item_code"] if all_dates else ["item_code"]
    agg = (fact.groupBy(*keys).agg(F.count(col).alias("rows_count"), value.alias("metric_value"))
               .where(F.col("rows_count") > 0))
    rank_keys = [nulls_last("metric_value", o), F.col("item_code").asc()]
    if all_dates:
        w = Window.partitionBy("trade_date").orderBy(*rank_keys)
        top = agg.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= lim).drop("_r")
    else:
        top = agg.orderBy(*rank_keys).limit(lim)
    out = _with_names(top, star, ("item",), bounded=not all_dates)
    lead = [date_text("trade_date").alias("trade_date")] if all_dates else []
    out = out.select(*lead, "item_code", "item_name", "rows_count",
                     round2("metric_value").alias("metric_value"))
    out = out.orderBy(*([F.col("trade_date")] if all_dates else []), *rank_keys)
    meta = P.result_meta(metric=m, limit=lim)
    meta["total"] = lambda: out.count()
    return out, meta


# ---------------------------------------------------------------- R1

def dimension_list(star: Star, kind: str, q=None, sort=None, order=None, limit=None, offset=None):
    """Search (S10), count, sort by name (default) / code / id, page.
    Order defaults to DESC; ties are broken by id so pages are stable."""
    if kind not in CODE_DIMS:
        raise ValueError("invalid dimension kind")
    code, name = CODE_DIMS[kind]
    qq = P.validate_search(P.text(q))
    lim, off = P.parse_limit(limit, 50, 500), P.parse_offset(offset)
    o = P.parse_order(order)
    s = {"code": code, "id": "id"}.get(P.text(sort).lower(), name)
    dim = star.dim(kind)
    if qq:
        dim = dim.where(like_search(code, name, qq))
    keys = [pg_order(s, o)] + ([F.col("id").asc()] if s != "id" else [])
    total = P.SeenTotal(dim)
    page = total.watch().orderBy(*keys).offset(off).limit(lim).select(
        "id", F.col(code).alias("code"), F.col(name).alias("name"))
    meta = P.result_meta(limit=lim, offset=off) | {"total": total}
    return page, meta


# ---------------------------------------------------------------- R2

def coverage(star: Star):
    """R2: earliest and latest trade date, fact row count (exact, where the
    reference returns a planner estimate) and the latest ingestion run."""
    f = star.fact.agg(date_text(F.min("trade_date")).alias("earliest_trade_date"),
                      date_text(F.max("trade_date")).alias("latest_trade_date"),
                      F.count(F.lit(1)).alias("fact_rows_total")).withColumn("_k", F.lit(1))
    if star.runs is None:
        return f.drop("_k"), {}
    r = star.runs.agg(F.max_by(F.struct("id", "status", "run_type", "finished_at"), "id").alias("r"))
    r = r.select(F.lit(1).alias("_k"),
                 F.col("r.id").alias("last_ingestion_run_id"),
                 F.col("r.status").alias("last_ingestion_status"),
                 F.col("r.run_type").alias("last_ingestion_run_type"),
                 F.col("r.finished_at").alias("last_ingestion_finished_at"))
    # both sides are single-row aggregates
    return f.join(r, "_k", "left").drop("_k"), {}


# ---------------------------------------------------------------- R12 / R13

def ingestion_runs(star: Star, limit=None, offset=None):
    """Runs, newest id first, paged."""
    lim, off = P.parse_limit(limit, 50, 500), P.parse_offset(offset)
    total = P.SeenTotal(star.runs)
    page = total.watch().orderBy(F.col("id").desc()).offset(off).limit(lim)
    meta = P.result_meta(limit=lim, offset=off) | {"total": total}
    return page, meta


def ingestion_files(star: Star, run_id=None, limit=None, offset=None):
    """File logs, newest id first, optionally of one run (positive id)."""
    lim, off = P.parse_limit(limit, 100, 1000), P.parse_offset(offset)
    files = star.files
    if P.text(run_id):
        s = P.text(run_id)
        if not s.lstrip("+").isdigit() or int(s) <= 0:
            raise ValueError("run_id: a number above 0 is needed")
        files = files.where(F.col("run_id") == int(s))
    total = P.SeenTotal(files)
    page = total.watch().orderBy(F.col("id").desc()).offset(off).limit(lim)
    meta = P.result_meta(limit=lim, offset=off) | {"total": total}
    return page, meta
