import datetime as dt

import pytest

from seika.operators import prices as R
from seika.plans import params as P
from seika.schemas import Star

T0 = dt.datetime(2024, 1, 1)


def star(spark, facts):
    fact = spark.createDataFrame(facts, """trade_date date, weekday_ja string, market_code string,
        item_code string, origin_code string, grade string, class string, product_name string,
        unit_weight string, item_total_ton decimal(14,3), arrival_ton decimal(14,3), price_high_yen int,
        price_mid_yen int, price_low_yen int, trend_label string, source_file string, source_row_no int""")
    dm = spark.createDataFrame([(1, "M1", "East", T0, T0), (2, "M2", "West", T0, T0), (3, "M3", "North", T0, T0)],
                               "id bigint, market_code string, market_name string, created_at timestamp, updated_at timestamp")
    di = spark.createDataFrame([(1, "I1", "Radish", T0, T0), (2, "I2", "Turnip", T0, T0)],
                               "id bigint, item_code string, item_name string, created_at timestamp, updated_at timestamp")
    do = spark.createDataFrame([(1, "O1", "Chiba", T0, T0)],
                               "id bigint, origin_code string, origin_name string, created_at timestamp, updated_at timestamp")
    dg = spark.createDataFrame([(1, "", "", "", "", T0, T0)],
                               "id bigint, grade string, class string, product_name string, unit_weight string, "
                               "created_at timestamp, updated_at timestamp")
    return Star(fact=fact, dim_market=dm, dim_item=di, dim_origin=do, dim_grade=dg)


def f(d, m, i, mid, arr, row, item_total=None):
    from decimal import Decimal
    return (d, "月", m, i, "O1", "", "", "", "", Decimal(item_total) if item_total else None,
            Decimal(arr) if arr is not None else None, None, mid, None, None, f"{d:%Y%m%d}/a.csv", row)


D1, D2 = dt.date(2024, 1, 10), dt.date(2024, 1, 11)


@pytest.fixture
def st(spark):
    return star(spark, [
        f(D1, "M1", "I1", 100, "1.005", 2), f(D1, "M2", "I1", None, "2.000", 3), f(D1, "M3", "I1", 300, None, 4),
        f(D2, "M1", "I1", 110, "1.000", 2), f(D2, "M2", "I1", 90, "3.000", 3), f(D2, "M1", "I2", 50, "5.000", 4),
    ])


def test_params_validation(spark):
    with pytest.raises(ValueError):
        P.date_filter(from_="2024-01-10", to="2024-01-01")
    with pytest.raises(ValueError):
        P.date_filter(from_="2023-01-01", to="2024-01-03")          # > 366 days
    with pytest.raises(ValueError):
        P.date_filter(date="2024/01/01")
    with pytest.raises(ValueError):
        P.date_filter(date="2024-01-01", include_single_date=False)
    df = P.date_filter(as_of=dt.date(2024, 3, 1))
    assert df.default_from == dt.date(2024, 1, 30)
    assert P.parse_limit("abc", 100, 2000) == 100 and P.parse_limit("99999", 100, 2000) == 2000
    assert P.parse_limit("0", 50, 500) == 1 and P.parse_offset("-5") == 0
    assert P.parse_order("ASC") == "asc" and P.parse_order("up") == "desc"
    with pytest.raises(ValueError):
        P.validate_code("item_code", "あ" * 11)                     # 33 bytes
    with pytest.raises(ValueError):
        P.validate_search("q" * 101)


def test_daily_desc_nulls_first_and_names(st):
    out, meta = R.prices_daily(st, "I1", from_="2024-01-01", to="2024-01-31", sort="price_mid", as_of=D2)
    rows = [(r.market_code, r.price_mid_yen, r.market_name) for r in out.collect()]
    assert rows == [("M2", None, "West"), ("M3", 300, "North"), ("M1", 110, "East"),
                    ("M1", 100, "East"), ("M2", 90, "West")]
    assert meta["limit"] == 100
    asc, _ = R.prices_daily(st, "I1", from_="2024-01-01", to="2024-01-31", sort="arrival", order="asc", limit=2)
    # 1.005 as a double is 1.00499...: math.Round(x*100)/100 gives 1.0, as the reference does
    assert [(r.market_code, r.arrival_ton, r.source_row_no) for r in asc.collect()] == [("M1", 1.0, 2), ("M1", 1.0, 2)]


def test_unknown_code_is_empty(st):
    out, _ = R.prices_daily(st, "NOPE", from_="2024-01-01", to="2024-01-31")
    assert out.count() == 0
    assert R.resolve_codes(st, "I1", "M9").count() == 0
    assert [tuple(r) for r in R.resolve_codes(st, "I1", "M2").collect()] == [(1, 2)]


def test_latest_with_total(st):
    out, meta = R.prices_latest(st, "I1", limit=1)
    rows = out.collect()
    assert len(rows) == 1 and rows[0].trade_date == "2024-01-11" and rows[0].total_count == 2
    assert meta["latest_trade_date"]() == "2024-01-11"
    with pytest.raises(ValueError):
        R.prices_latest(st, "I1", from_="2024-01-01")


def test_trend_summary_compare_rank(st):
    tr, _ = R.prices_trend(st, "I1", from_="2024-01-01", to="2024-01-31")
    # IEEE: 3.005 * 100 is exactly 300.5 (rounds up) while 1.005 * 100 is 100.4999...
    assert [tuple(r) for r in tr.collect()] == [("2024-01-10", 2, 200.0, 300, 100, 3.01),
                                                ("2024-01-11", 2, 100.0, 110, 90, 4.0)]
    sm, _ = R.prices_summary(st, "I1", "month", from_="2024-01-01", to="2024-01-31")
    assert [tuple(r) for r in sm.collect()] == [("2024-01", 5, 150.0, 7.01)]
    with pytest.raises(ValueError):
        R.prices_summary(st, "I1", "year", from_="2024-01-01", to="2024-01-31")
    cm, _ = R.compare_markets(st, "2024-01-10", "I1")
    assert [(r.market_code, r.metric_value) for r in cm.collect()] == [("M2", None), ("M3", 300.0), ("M1", 100.0)]
    rk, _ = R.rank_items(st, "2024-01-11", "price_mid", limit=1)
    assert [(r.item_code, r.metric_value, r.rows_count) for r in rk.collect()] == [("I1", 100.0, 2)]
    with pytest.raises(ValueError):
        R.rank_items(st, "2024-01-11", "volume")


def test_dimension_list(st):
    page, meta = R.dimension_list(st, "market", q="st", sort="code", order="asc")
    assert [r.code for r in page.collect()] == ["M1", "M2"]
    assert meta["total"]() == 2
    page, _ = R.dimension_list(st, "market")
    assert [r.name for r in page.collect()] == ["West", "North", "East"]
