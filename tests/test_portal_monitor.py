import datetime as dt
import random

from pyspark.sql import functions as F

from seika.operators import monitor as M
from seika.operators.numbering import running
from seika.sources import portal as P

PAGE = """<html><input type="hidden" name="s006.dataDate" value="20240105">
<input name="s006.dataDate"   value="20240104"><input name="s006.dataDate" value="20240105">
<h3 class="h3_title" id="x">  2024年1月5日
 (金) </h3><table>
<tr> <td class="kubun_td3_norb_left"> 1 </td><td class="kubun_td3_norb_left">東京都
中央卸売市場</td><td><a onclick="chohyoSubmit('form003','A1')">v</a><a onclick="chohyoSubmit('form003','A2')">f</a>
<a onclick="chohyoSubmit('form003','A3')">x</a></td></tr>
<tr><td class="kubun_td3_norb_left">2</td><td class="kubun_td3_norb_left">大阪市場</td><td>no data</td></tr>
<tr><td class="kubun_td3_norb_left">3</td><td class="kubun_td3_norb_left">The Osaka Market</td>
<td><a onclick="chohyoSubmit('form003','B1')">v</a></td></tr></table></html>"""


def test_portal_reference_patterns(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<html>nothing</html>")], "page_id int, html string")
    dates = P.page_dates(pages).orderBy("page_id", "ord").collect()
    assert [(r.page_id, r.ord, r.value) for r in dates] == [(1, 1, "20240105"), (1, 2, "20240104"), (2, None, None)]
    assert [r.has_match for r in dates] == [True, True, False]
    label = pages.select(P.date_label("html", F.lit("20240105"))).collect()
    assert label[0][0] == "2024年1月5日 (金)" and label[1][0] == "20240105"
    rows = P.market_rows(pages).orderBy("row_no")
    got = [(r.row_no, r.market, list(r.csv_ids)) for r in rows.collect()]
    assert got == [("1", "東京都 中央卸売市場", ["A1", "A2", "A3"]), ("3", "The Osaka Market", ["B1"])]
    assert [r.row_no for r in P.filter_markets(rows, "  osaka ").collect()] == ["3"]
    assert P.filter_markets(rows, "  ").count() == 2
    cats = P.csv_id_categories(rows).orderBy("row_no", "id_pos").collect()
    assert [(r.csv_id, r.category) for r in cats] == [("A1", "vegetable"), ("A2", "fruit"), ("A3", "col3"),
                                                      ("B1", "vegetable")]
    assert [r.page_id for r in P.pages_without_rows(pages, rows).collect()] == [2]


def test_resolve_dates():
    assert P.resolve_dates(date="2024xx") == ("single", None, None)
    assert P.resolve_dates(from_="20240101", to="20240103")[1:] == (dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    import pytest
    with pytest.raises(ValueError):
        P.resolve_dates(from_="20240105", to="20240101")


def _req(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, method string, path string, "
                                       "status int, seconds double")


def test_histogram_p95_and_alerts(spark):
    t = dt.datetime(2024, 1, 1, 0, 1)
    rows = [(i, t + dt.timedelta(minutes=5 * (i // 2)), "GET", "/ready" if i % 2 else "/v1/items/1",
             500 if i >= 4 else 200, 0.004 if i < 6 else 20.0) for i in range(10)]
    req = _req(spark, rows)
    hist = {(r.path, r.le): r.cumulative_count for r in M.latency_histogram(req).collect()}
    assert hist[("/ready", "0.005")] == 3 and hist[("/ready", "+Inf")] == 5 and hist[("/ready", "10")] == 3
    p95 = M.p95_from_buckets(M.latency_histogram(req)).collect()[0]
    assert (p95.p95_le, p95.p95_ms) == ("+Inf", 10000)
    snaps = M.monitor_snapshots(req).orderBy("timestamp").collect()
    assert [s.http_total for s in snaps] == [2, 4, 6, 8, 10]
    assert [s.ready_ok for s in snaps] == [1, 1, 0, 0, 0]
    assert snaps[0].timestamp == "2024-01-01T00:05:00Z" and snaps[0].http_p95_ms == 5
    alerts = {a.timestamp: list(a.alerts) for a in M.alert_rules(M.monitor_snapshots(req)).collect()}
    assert alerts["2024-01-01T00:25:00Z"] == ["5xx_rate_high", "http_p95_high", "ready_failed_consecutive",
                                              "db_errors_increased"]
    assert "ready_failed_consecutive" not in alerts["2024-01-01T00:20:00Z"]
    deltas = M.snapshot_deltas(M.monitor_snapshots(req), recent=3).orderBy("timestamp").collect()
    assert [(d.delta_total, d.rate_5xx) for d in deltas] == [(0, 0.0), (2, 1.0), (2, 1.0)]


def test_empty_histogram_has_no_p95(spark):
    req = _req(spark, [])
    p = M.p95_from_buckets(M.latency_histogram(req)).collect()[0]
    assert (p.p95_le, p.p95_ms) == (None, None)


def test_empty_ticks_db_calls_and_status_as_of_the_tick(spark):
    t = dt.datetime(2024, 1, 1, 0, 1)
    req = _req(spark, [(1, t, "GET", "/ready", 503, 0.1), (2, t + dt.timedelta(minutes=21), "GET", "/x", 500, 0.1)])
    runs = spark.createDataFrame(
        [(1, t, t + dt.timedelta(minutes=6), "failed"), (2, t + dt.timedelta(minutes=12), None, "running")],
        "id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string")
    calls = spark.createDataFrame([(t + dt.timedelta(minutes=7), True), (t + dt.timedelta(minutes=7), False)], "ts timestamp_ntz, error boolean")
    got = M.monitor_snapshots(req, runs, db_calls=calls).orderBy("timestamp").collect()
    assert [(r.timestamp[11:16], r.ready_ok, r.http_total, r.http_5xx, r.db_errors_total, r.ingestion_latest_status) for r in got] == [
        ("00:05", 0, 1, 1, 0, "running"), ("00:10", 1, 1, 1, 1, "failed"), ("00:15", 1, 1, 1, 1, "running"),
        ("00:20", 1, 1, 1, 1, "running"), ("00:25", 1, 2, 2, 1, "running")]
    assert [r.db_errors_total for r in M.monitor_snapshots(req).orderBy("timestamp").collect()] == [0, 0, 0, 0, 1]


def test_gauge_resets_and_goes_on(spark):
    t = dt.datetime(2024, 1, 1)
    ev = [(i, t + dt.timedelta(seconds=i), d) for i, d in enumerate([-1, -1, 1, 1, -1, -1, -1, 1])]
    frame = spark.createDataFrame(ev, "event_id long, t timestamp_ntz, delta int")
    for ranges in (1, 3, None):
        out = running(frame, ["t", "delta", "event_id"], {"x": "delta"}, minima={"low": "x"}, ranges=ranges)
        got = [r.x - min(0, r.low) for r in out.orderBy("event_id").collect()]
        assert got == [0, 0, 1, 2, 1, 0, 0, 1]
    assert [r.inflight for r in M.gauge(frame).orderBy("event_id").collect()] == [0, 0, 1, 2, 1, 0, 0, 1]


def test_alerts_of_small_blocks_equal_a_plain_loop(spark):
    # mostly calm: most snapshots raise nothing
    rnd = random.Random(2)
    rows, total, bad, db = [], 0, 0, 0
    for i in range(300):
        calm = rnd.random() < 0.8
        total, bad, db = total + rnd.choice([0, 50]), bad + (0 if calm else rnd.randint(0, 3)), db + (0 if calm else 1)
        rows.append((f"2024-01-{1 + i // 144:02d}T{i // 6 % 24:02d}:{i % 6 * 10:02d}:00Z", 0 if 100 <= i < 105 or i % 40 == 7 else 1,
                     total, bad, db, 900 if i % 50 == 3 else 100, "failed" if i % 70 == 9 else "success"))
    snaps = spark.createDataFrame(rows, "timestamp string, ready_ok int, http_total long, http_5xx long, db_errors_total long, "
                                        "http_p95_ms int, ingestion_latest_status string")
    exp = {}
    for i in range(1, len(rows)):
        (_, _, t0, b0, d0, _, _), (ts, _, t1, b1, d1, p95, st) = rows[i - 1], rows[i]
        rate = (b1 - b0) / (t1 - t0) if t1 > t0 else 0.0
        found = [("5xx_rate_high", rate > 0.02), ("http_p95_high", p95 > 800),
                 ("ready_failed_consecutive", i >= 2 and not any(r[1] for r in rows[i - 2:i + 1])),
                 ("db_errors_increased", d1 > d0), ("ingestion_status_bad", st == "failed")]
        if any(y for _, y in found):
            exp[ts] = [n for n, y in found if y]
    assert 20 < len(exp) < 150
    for block_rows in (2, 5, 100_000):
        assert {r.timestamp: list(r.alerts) for r in M.alert_rules(snaps, block_rows).collect()} == exp


def test_no_task_takes_all_snapshots(spark):
    t = dt.datetime(2024, 1, 1)
    req = _req(spark, [(i, t + dt.timedelta(minutes=7 * i), "GET", "/", 500, 0.1) for i in range(9)])
    runs = spark.createDataFrame([(1, t, None, "running")], "id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string")
    text = M.alert_rules(M.monitor_snapshots(req, runs))._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    # one task sees only the totals of the ranges (one row each), never the snapshots
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert "_block" in text and single and all("HashAggregate(keys=[_range" in "".join(lines[i + 1:i + 3]) for i in single)


def test_inflight(spark):
    t = dt.datetime(2024, 1, 1)
    req = _req(spark, [(1, t, "GET", "/", 200, 2.0), (2, t + dt.timedelta(seconds=1), "GET", "/", 200, 2.0),
                       (3, t + dt.timedelta(seconds=2), "GET", "/", 200, 1.0)])
    got = [(r.event_id, r.delta, r.inflight) for r in M.inflight_requests(req).orderBy("t", "delta", "event_id").collect()]
    assert got == [(1, 1, 1), (2, 1, 2), (1, -1, 1), (3, 1, 2), (2, -1, 1), (3, -1, 0)]
