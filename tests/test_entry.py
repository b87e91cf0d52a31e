import decimal
import os

import duckdb

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.columns == ["trade_date", "rows_count", "avg_price_mid_yen", "max_price_mid_yen",
                          "min_price_mid_yen", "arrival_ton_sum"]
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_some_queries_match_oracle(spark):
    if not os.path.exists(SF):
        return
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for key in ("prices_trend_all", "summary_week", "rank_items_arrival", "http_request_counts", "portal_dates"):
        got = E.queries()[key](spark, SF)
        cols = got.columns
        value = lambda x: f"{float(x):.6f}" if isinstance(x, (float, int, decimal.Decimal)) else str(x)
        mine = sorted(tuple(value(r[c]) for c in sorted(cols)) for r in got.collect())
        cur = con.execute(E.oracle_sql()[key])
        ocols = [d[0] for d in cur.description]
        theirs = sorted(tuple(value(r[ocols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
        assert sorted(cols) == sorted(ocols), key
        assert mine == theirs and mine, key
