"""Plan shapes of the point queries on a stored warehouse: filters reach the
Parquet scan, pages / top-k are cut before dimension joins, joins broadcast."""

import contextlib
import io

from pyspark.sql import functions as F

from seika.operators import prices as R
from seika.plans import params as P
from seika.sources.warehouse import Warehouse
from tests.test_prices import star as make_star, f, D1, D2


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def stored(spark, tmp_dir):
    st = make_star(spark, [f(D1, "M1", "I1", 100, "1.005", 2), f(D2, "M2", "I1", 90, "3.000", 3),
                           f(D2, "M1", "I2", 50, "5.000", 4)])
    wh = Warehouse(spark, f"{tmp_dir}/wh")
    wh.write_star(st)
    return wh.read()


def test_daily_page_plan(spark, tmp_dir):
    st = stored(spark, tmp_dir)
    p = plan(R.prices_daily(st, "I1", from_="2024-01-01", to="2024-01-31", limit=20)[0])
    assert "EqualTo(item_code,I1)" in p and "GreaterThanOrEqual(trade_date,2024-01-01)" in p
    assert "TakeOrderedAndProject" in p and "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    # the page is cut on the fact scan, before any join
    assert p.index("TakeOrderedAndProject") > p.index("BroadcastHashJoin")   # deeper in the tree = later in text


def test_trend_is_pushed_aggregate(spark, tmp_dir):
    st = stored(spark, tmp_dir)
    p = plan(R.prices_trend(st, "I1", from_="2024-01-01", to="2024-01-31")[0])
    assert "EqualTo(item_code,I1)" in p and "HashAggregate" in p and "Join" not in p
    assert "ReadSchema: struct<trade_date:date,item_code:string,arrival_ton:decimal(14,3),price_mid_yen:int>" in p


def test_rank_top_k_before_join(spark, tmp_dir):
    st = stored(spark, tmp_dir)
    p = plan(R.rank_items(st, "2024-01-11", "arrival", limit=5)[0])
    assert "TakeOrderedAndProject" in p and "BroadcastHashJoin" in p
    assert "EqualTo(trade_date,2024-01-11)" in p


def test_months_are_pruned_by_their_dates(spark, tmp_dir):
    import datetime as dt

    rows = [f(dt.date(2024, m, 5), "M1", "I1", 100 + m, "1.000", m) for m in range(1, 7)]
    st = make_star(spark, rows)
    wh = Warehouse(spark, f"{tmp_dir}/wh")
    st.fact = st.fact.withColumn("load_month", F.date_format("trade_date", "yyyyMM"))
    wh.write_star(st)
    assert set(wh.months()) == {f"20240{m}" for m in range(1, 7)}
    st = wh.read()
    for df in (R.prices_daily(st, "I1", from_="2024-03-01", to="2024-03-31")[0], R.prices_trend(st, "I1", from_="2024-03-01", to="2024-03-31")[0],
               R.prices_summary(st, "I1", "month", from_="2024-03-01", to="2024-03-31")[0], R.compare_markets(st, "2024-03-05", "I1")[0],
               R.rank_items(st, "2024-03-05")[0]):
        p = plan(df)
        assert "PartitionFilters: [(load_month" in p or "PartitionFilters: [isnotnull(load_month" in p
        assert "202403" in p and "202404" not in p.split("PartitionFilters")[1].split("PushedFilters")[0]
        assert df.count() == 1


def test_hot_month_is_split_over_files(spark, tmp_dir):
    import os

    wh = Warehouse(spark, f"{tmp_dir}/wh")
    st = make_star(spark, [f(D1, "M1", "I1", 100, "1.005", 2)])
    numbers = spark.range(0, 40_000, 1, 8).select(F.col("id").cast("int").alias("n"))
    many = numbers.crossJoin(F.broadcast(st.fact)).withColumn("source_row_no", F.col("n")).drop("n").withColumn("load_month", F.lit("202401"))
    st.fact = many.withColumn("source_file", F.sha2(F.col("source_row_no").cast("string"), 256))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        wh.write_star(st)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [n for n in os.listdir(f"{tmp_dir}/wh/fact_prices_daily/load_month=202401") if n.endswith(".parquet")]
    assert len(files) > 2 and wh.read().fact.count() == 40_000


def test_latest_reads_the_months_that_hold_it(spark, tmp_dir):
    months = [D1.replace(month=m) for m in range(1, 10)]
    st = make_star(spark, [f(d, "M1", "I2", 50, "5.000", i + 2) for i, d in enumerate(months)]
                   + [f(months[2], "M1", "I1", 100, "1.005", 20), f(months[2], "M2", "I1", 90, "3.000", 21), f(D1, "M2", "I1", 90, "3.000", 22)])
    wh = Warehouse(spark, f"{tmp_dir}/wh")
    wh.write_star(st)
    stored_star = wh.read()
    got, meta = R.prices_latest(stored_star, "I1")
    rows = got.collect()
    assert [(r.trade_date, r.market_code, r.total_count) for r in rows] == [
        (r.trade_date, r.market_code, r.total_count) for r in R.prices_latest(st, "I1")[0].collect()]
    assert len(rows) == 2 and rows[0].trade_date == months[2].isoformat()
    p = plan(got)
    first = (p.split("PartitionFilters: [", 1) + [""])[1].split("]", 1)[0]
    assert "load_month" in first
    assert R.latest_date(stored_star, "I1", "M2") == months[2] and R.latest_date(stored_star, "none") is None
    assert R.prices_latest(stored_star, "none")[0].collect() == []
    assert P.answer(got, meta)[1]["total"] == 2 and P.answer(got, meta)[1]["latest_trade_date"] == months[2].isoformat()


def test_total_is_seen_in_the_action_of_the_page(spark, tmp_dir):
    st = stored(spark, tmp_dir)
    page, meta = R.dimension_list(st, "item", limit=1)
    assert "CollectMetrics" in plan(page)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("page-with-total", "page")
    rows, found = P.answer(page, meta)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 1 and found["total"] == 2 and len(jobs.getJobIdsForGroup("page-with-total")) == 1
    assert P.resolve_meta(R.dimension_list(st, "item", limit=1)[1])["total"] == 2      # or counted on its own


def test_a_filter_on_the_reason_does_not_parse_again(spark):
    """accepted() and rejected() over parse_rows match each field's patterns as often as the parse alone."""
    from seika.operators import ingest as I
    from seika.schemas import REQUIRED_HEADERS
    raw = spark.createDataFrame([("x",) * len(REQUIRED_HEADERS)] * 3, ", ".join(f"`{h}` string" for h in REQUIRED_HEADERS)).repartition(2)
    parsed = I.parse_rows(raw)

    def patterns(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert patterns(I.accepted(parsed)) <= patterns(parsed) and patterns(I.rejected(parsed)) <= patterns(parsed)
    assert I.rejected(parsed).count() == 3 and I.accepted(parsed).count() == 0


def test_a_dimension_reads_its_batch_once(spark):
    """The batch of an upsert is aggregated once; names and ids are those of the newest rows."""
    import datetime as dt

    from seika.operators import ingest as I
    from seika.sources import testdata as TD
    rows = spark.createDataFrame([("M1", "old", "20240101", "f", 2), ("M1", "new", "20240102", "f", 2), ("M1", None, "20240102", "f", 1),
                                  ("M2", "a", None, None, 9), ("M2", "b", "20230101", None, 2), ("M2", "b", "20230101", None, 3)],
                                 "market_code string, market_name string, date_key string, source_file string, source_row_no int")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    old = TD.dimension(rows.where("market_name = 'old'"), "market")
    out = I.upsert_code_dimension(old, rows.mapInArrow(counted, rows.schema), "market", dt.datetime(2024, 1, 3))
    assert sorted((r.id, r.market_code, r.market_name) for r in out.collect()) == [(1, "M1", "new"), (2, "M2", "b")]
    assert seen.value == 6
