"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

The parameters are the fixed ones of FIXTURES.md. ``ORACLE`` holds the DuckDB
SQL that recomputes a key; keys without an entry get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seika.operators import prices as R
from seika.plans import oracle as O
from seika.plans import params as P
from seika.session import configure
from seika.sources import testdata as TD

Query = Callable[[SparkSession, str], DataFrame]

ITEM, AS_OF = TD.FIXED_ITEM, TD.FIXED_AS_OF
FROM, TO, DATE = TD.FIXED_FROM.isoformat(), TD.FIXED_TO.isoformat(), TD.FIXED_DATE.isoformat()

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run
    return deco


def _star(spark, sf_dir, row_no=False):
    return TD.star(spark, sf_dir, with_row_no=row_no)


_ITEM_RANGE = f"WHERE item_code = '{O.ITEM}' AND trade_date >= DATE '{O.FROM}' AND trade_date <= DATE '{O.TO}'"

# ------------------------------------------------------------------ R queries


@register("prices_trend", O.trend_sql(_ITEM_RANGE))
def prices_trend(spark, sf_dir):
    """Daily price trend of one item over 1998."""
    return R.prices_trend(_star(spark, sf_dir), ITEM, from_=FROM, to=TO, as_of=AS_OF)[0]


@register("prices_trend_all", O.trend_sql("", "item_code, trade_date"))
def prices_trend_all(spark, sf_dir):
    """R7 for every item over the whole history (grouped by item and day)."""
    return R.prices_trend(_star(spark, sf_dir), all_items=True, full_history=True)[0]


def _preset_where(preset: str) -> str:
    from seika.functions.dates import add_date
    y, m, d = R.TREND_PRESETS[preset]
    start = add_date(AS_OF, y, m, d)
    return (f"WHERE item_code = '{O.ITEM}' AND trade_date >= DATE '{start.isoformat()}' "
            f"AND trade_date <= DATE '{AS_OF.isoformat()}'")


for _p in ("1m", "6m", "1y"):
    def _mk(p):
        @register(f"trend_{p}", O.trend_sql(_preset_where(p)))
        def _q(spark, sf_dir):
            """Preset trend window ending at as_of (S9 calendar arithmetic)."""
            return R.prices_trend_preset(_star(spark, sf_dir), p, AS_OF, ITEM)[0]
        return _q
    _mk(_p)


for _g in ("day", "week", "month"):
    def _mk_summary(g):
        @register(f"summary_{g}", O.summary_sql(O.PERIODS[g], _ITEM_RANGE))
        def _q(spark, sf_dir):
            """Per-period summary of one item over 1998."""
            return R.prices_summary(_star(spark, sf_dir), ITEM, g, from_=FROM, to=TO, as_of=AS_OF)[0]
        return _q
    _mk_summary(_g)


@register("summary_week_all", O.summary_sql(O.PERIODS["week"], "", all_items=True))
def summary_week_all(spark, sf_dir):
    """R9 weekly, every item, whole history."""
    return R.prices_summary(_star(spark, sf_dir), group_by="week", all_items=True, full_history=True)[0]


@register("prices_daily", O.prices_daily())
def prices_daily(spark, sf_dir):
    """First page (100 rows) of an item's 1998 rows, newest first."""
    return R.prices_daily(_star(spark, sf_dir, True), ITEM, from_=FROM, to=TO, as_of=AS_OF)[0]


@register("prices_daily_by_price", O.prices_daily_by_price())
def prices_daily_by_price(spark, sf_dir):
    """R5 sorted by mid price DESC (nulls first), limit 50 offset 20."""
    return R.prices_daily(_star(spark, sf_dir, True), ITEM, from_=FROM, to=TO, sort="price_mid",
                          limit=50, offset=20, as_of=AS_OF)[0]


@register("prices_latest", O.prices_latest())
def prices_latest(spark, sf_dir):
    """Rows of an item on its latest trade date, with the total before paging."""
    return R.prices_latest(_star(spark, sf_dir, True), ITEM)[0]


def _busiest_latest(star) -> str | None:
    """The item with the most rows on its latest date."""
    per_day = star.fact.groupBy("item_code", "trade_date").agg(F.count(F.lit(1)).alias("n"))
    last = per_day.groupBy("item_code").agg(F.max_by("n", "trade_date").alias("n"))
    row = last.orderBy(F.col("n").desc(), "item_code").first()
    return row and row.item_code


@register("prices_latest_busiest", O.prices_latest("(SELECT item_code FROM busiest)", O.BUSIEST_LATEST + ","))
def prices_latest_busiest(spark, sf_dir):
    """R6 for the item with the most rows on its latest date: order and total of a page of several rows."""
    star = _star(spark, sf_dir, True)
    return R.prices_latest(star, _busiest_latest(star) or ITEM)[0]


@register("result_meta", O.result_meta_sql(3))
def result_meta(spark, sf_dir):
    """The metadata of five results, each taken in the action that gives its rows."""
    star = _star(spark, sf_dir, True)
    results = {
        "dimension_list": R.dimension_list(star, "item", q="ring", sort="code", order="asc", limit=20, offset=2),
        "prices_latest": R.prices_latest(star, _busiest_latest(star) or ITEM, limit=1),
        "prices_trend": R.prices_trend(star, ITEM, from_=FROM, to=TO, as_of=AS_OF),
        "prices_summary": R.prices_summary(star, group_by="month", all_items=True, as_of=AS_OF),
        "rank_items": R.rank_items(star, DATE, "arrival", limit=3),
    }
    names = ("total", "limit", "latest_trade_date", "default_from", "default_window_days")
    rows = []
    for query, (df, meta) in results.items():
        found = P.answer(df, meta)[1]
        rows.append((query, *[found.get(n) for n in names]))
    return spark.createDataFrame(rows, "query string, total long, `limit` int, latest_trade_date string, default_from string, default_window_days int")


_ON_DATE = f"WHERE trade_date = DATE '{O.DATE}'"


@register("compare_markets_price_all", O.compare_sql("price_mid", _ON_DATE, all_items=True))
def compare_markets_price_all(spark, sf_dir):
    """R10 (AVG price_mid per market) for every item on the fixed date."""
    return R.compare_markets(_star(spark, sf_dir), DATE, metric="price_mid", all_items=True)[0]


@register("compare_markets_arrival_all", O.compare_sql("arrival", _ON_DATE, all_items=True))
def compare_markets_arrival_all(spark, sf_dir):
    """R10 (SUM arrival per market) for every item on the fixed date."""
    return R.compare_markets(_star(spark, sf_dir), DATE, metric="arrival", all_items=True)[0]


@register("compare_markets_price",
          O.compare_sql("price_mid", _ON_DATE + f" AND item_code = '{O.ITEM}'"))
def compare_markets_price(spark, sf_dir):
    """R10 for the fixed item and date."""
    return R.compare_markets(_star(spark, sf_dir), DATE, ITEM, metric="price_mid")[0]


@register("compare_markets_arrival",
          O.compare_sql("arrival", _ON_DATE + f" AND item_code = '{O.ITEM}'"))
def compare_markets_arrival(spark, sf_dir):
    """R10 arrival for the fixed item and date."""
    return R.compare_markets(_star(spark, sf_dir), DATE, ITEM, metric="arrival")[0]


for _m in ("price_mid", "arrival"):
    def _mk_compare(metric):
        @register(f"compare_markets_busiest_{metric}",
                  O.compare_sql(metric, "SEMI JOIN busiest USING (trade_date, item_code)", extra=O.BUSIEST_DAY))
        def _q(spark, sf_dir):
            """R10 for the date and item with the most markets."""
            star = _star(spark, sf_dir)
            row = (star.fact.groupBy("trade_date", "item_code").agg(F.count_distinct("market_code").alias("n"))
                   .orderBy(F.col("n").desc(), "trade_date", "item_code").first())
            date, item = (row.trade_date.isoformat(), row.item_code) if row else (DATE, ITEM)
            return R.compare_markets(star, date, item, metric=metric)[0]
        return _q
    _mk_compare(_m)


@register("rank_items_arrival", O.rank_sql("arrival", _ON_DATE, 5))
def rank_items_arrival(spark, sf_dir):
    """Top 5 items by arrival on the fixed date."""
    return R.rank_items(_star(spark, sf_dir), DATE, "arrival", limit=5)[0]


@register("rank_items_price", O.rank_sql("price_mid", _ON_DATE, 10, "ASC"))
def rank_items_price(spark, sf_dir):
    """Bottom 10 items by average mid price on the fixed date."""
    return R.rank_items(_star(spark, sf_dir), DATE, "price_mid", order="asc", limit=10)[0]


@register("rank_items_arrival_all", O.rank_sql("arrival", "", 5, per_date=True))
def rank_items_arrival_all(spark, sf_dir):
    """R11 top 5 by arrival for every date of the history (per-date top-k)."""
    return R.rank_items(_star(spark, sf_dir), metric="arrival", limit=5, all_dates=True)[0]


for _kind in ("market", "item", "origin"):
    def _mk_dim(kind):
        @register(f"dim_{kind}s", O.dim_sql(kind, None, f"{kind}_name", "DESC", 50, 0))
        def _q(spark, sf_dir):
            """Dimension list, default sort (name DESC), first page."""
            return R.dimension_list(_star(spark, sf_dir), kind)[0]
        return _q
    _mk_dim(_kind)


@register("dim_items_search", O.dim_sql("item", "ring", "item_code", "ASC", 20, 2))
def dim_items_search(spark, sf_dir):
    """R1 with a LIKE search on code/name, sorted by code ascending, offset 2."""
    return R.dimension_list(_star(spark, sf_dir), "item", q="ring", sort="code", order="asc",
                            limit=20, offset=2)[0]


@register("resolve_codes", O.with_fact(
    f"SELECT (SELECT id FROM dim_item WHERE item_code = '{O.ITEM}') AS item_id, "
    "(SELECT id FROM dim_market WHERE market_code = 'M0001') AS market_id"))
def resolve_codes(spark, sf_dir):
    """Code -> surrogate id of an item and a market."""
    return R.resolve_codes(_star(spark, sf_dir), ITEM, "M0001")


# the other query groups register themselves on import
from seika.plans import ingest_queries  # noqa: E402,F401
from seika.plans import monitor_queries  # noqa: E402,F401
from seika.plans import file_queries  # noqa: E402,F401
from seika.plans import misc_queries  # noqa: E402,F401
from seika.plans import stream_queries  # noqa: E402,F401


@register("date_filter", O.with_fact(
    "SELECT item_code, count(*) AS rows FROM fact WHERE trade_date >= DATE '1998-11-30' GROUP BY 1"))
def date_filter_default_window(spark, sf_dir):
    """With no date, from or to, the default window starts 31 days before
    as_of (S13); rows per item inside it."""
    f = P.date_filter(as_of=AS_OF)
    st = _star(spark, sf_dir)
    return st.fact.where(f.predicate).groupBy("item_code").agg(F.count(F.lit(1)).alias("rows"))


@register("param_clamp", O.dim_sql("market", None, "market_code", "DESC", 500, 0))
def param_clamp(spark, sf_dir):
    """Out-of-range paging parameters are clamped (limit 99999 -> 500,
    offset -5 -> 0) and an unknown order word means DESC."""
    return R.dimension_list(_star(spark, sf_dir), "market", sort="code", order="sideways",
                            limit="99999", offset="-5")[0]
