"""Registered monitoring queries (M1-M8, S11, S12) over the request view of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from seika.functions.http import EXACT_PATHS, OTHER_PATH, PREFIX_PATHS
from seika.operators import monitor as M
from seika.plans.registry import register
from seika.sources import testdata as TD

# ------------------------------------------------------------------ oracle SQL

_PATH_CASE = ("CASE " + " ".join(f"WHEN path = '{p}' THEN '{p}'" for p in EXACT_PATHS) + " "
              + " ".join(f"WHEN starts_with(path, '{p}') THEN '{p}'" for p in PREFIX_PATHS)
              + f" ELSE '{OTHER_PATH}' END")
_STATUS_CASE = ("CASE " + " ".join(f"WHEN status >= {k}00 AND status < {k + 1}00 THEN '{k}xx'"
                                   for k in range(1, 6)) + " ELSE 'other' END")
REQ = f"""
WITH req AS (
  SELECT event_id, ts, 'GET' AS method,
    CASE event_type WHEN 'view' THEN '/v1/prices/latest' WHEN 'click' THEN '/v1/prices/daily'
      WHEN 'purchase' THEN '/v1/rankings/items' WHEN 'signup' THEN '/v1/prices/trend/1m' ELSE '/ready' END AS path,
    CASE WHEN k % 20 = 0 THEN 500 WHEN k % 20 IN (1, 2) THEN 404 WHEN k % 20 = 3 THEN 302 ELSE 200 END AS status,
    value / 50 AS seconds
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
cls AS (SELECT *, {_PATH_CASE} AS path_label, {_STATUS_CASE} AS status_class FROM req)"""

_B = M.BUCKETS
_LABELS = M.BUCKET_LABELS


def _wide(keys: str, value: str = "seconds", extra: str = "") -> str:
    cnt = ", ".join(f"count(*) FILTER (WHERE {value} <= {b}) AS c{i}" for i, b in enumerate(_B))
    return f"SELECT {keys}, {cnt}, count(*) AS c{len(_B)}, sum({value}) AS sum_seconds{extra}"


def _long(keys: str, extra: str = "") -> str:
    parts = [f"SELECT {keys}{extra}, round(sum_seconds, 6) AS sum_seconds, c{len(_B)} AS observations, "
             f"{i} AS bucket, '{lbl}' AS le, c{i} AS cumulative_count FROM w"
             for i, lbl in enumerate(_LABELS)]
    return "\nUNION ALL\n".join(parts)


def _p95_idx(cum: list[str], total: str) -> str:
    whens = " ".join(f"WHEN {c} >= {total} * 0.95 THEN {i}" for i, c in enumerate(cum))
    return f"CASE WHEN {total} > 0 THEN (CASE {whens} ELSE {len(_LABELS) - 1} END) END"


def _p95_ms(idx: str) -> str:
    whens = " ".join(f"WHEN {idx} = {i} THEN {int(round(b * 1000))}" for i, b in enumerate(_B))
    return f"CASE {whens} WHEN {idx} = {len(_B)} THEN {M.P95_INF_MS} END"


SNAPSHOTS = REQ + f""",
t0 AS (SELECT time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS tick_end, count(*) AS n,
        count(*) FILTER (WHERE status_class = '5xx') AS n5xx, count(*) FILTER (WHERE status = 500) AS ndb,
        bool_or(path = '/ready' AND status >= 500) AS ready_failed,
        {", ".join(f"count(*) FILTER (WHERE seconds <= {b}) AS le{i}" for i, b in enumerate(_B))}
      FROM cls GROUP BY 1),
t AS (SELECT tick_end, coalesce(ready_failed, false) AS ready_failed, coalesce(n, 0) AS n, coalesce(n5xx, 0) AS n5xx,
        coalesce(ndb, 0) AS ndb, {", ".join(f"coalesce(le{i}, 0) AS le{i}" for i in range(len(_B)))}
      FROM (SELECT unnest(generate_series(min(tick_end), max(tick_end), INTERVAL 5 MINUTE)) AS tick_end FROM t0)
      LEFT JOIN t0 USING (tick_end)),
runs AS (SELECT k, d + INTERVAL 62 MINUTE AS started_at, CASE WHEN k % 7 <> 0 THEN d + INTERVAL 93 MINUTE END AS finished_at,
           CASE WHEN k % 5 = 0 THEN 'failed' WHEN k % 3 = 0 THEN 'partial_failed' ELSE 'success' END AS status
         FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS k FROM req)),
seen AS (SELECT tick_end, max(k) AS k FROM t JOIN runs ON started_at <= tick_end AND started_at > tick_end - INTERVAL 400 DAY GROUP BY 1),
st AS (SELECT tick_end, CASE WHEN finished_at <= tick_end THEN status ELSE 'running' END AS run_status FROM seen JOIN runs USING (k)),
c AS (SELECT tick_end, ready_failed, run_status,
        sum(n) OVER w AS http_total, sum(n5xx) OVER w AS http_5xx, sum(ndb) OVER w AS db_errors_total,
        {", ".join(f"sum(le{i}) OVER w AS cum{i}" for i in range(len(_B)))}
      FROM t LEFT JOIN st USING (tick_end) WINDOW w AS (ORDER BY tick_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
snap AS (SELECT strftime(tick_end, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
        CASE WHEN ready_failed THEN 0 ELSE 1 END AS ready_ok,
        CAST(http_total AS BIGINT) AS http_total, CAST(http_5xx AS BIGINT) AS http_5xx,
        CAST(db_errors_total AS BIGINT) AS db_errors_total,
        CAST({_p95_ms(_p95_idx([f"cum{i}" for i in range(len(_B))] + ["http_total"], "http_total"))} AS INTEGER)
          AS http_p95_ms,
        coalesce(run_status, 'unknown') AS ingestion_latest_status
      FROM c)"""

ORACLE = {
    "http_request_counts": REQ + """
SELECT path_label AS path, method, status_class, count(*) AS requests FROM cls GROUP BY 1, 2, 3""",
    "latency_histogram": REQ + ", w AS (" + _wide("method, path_label AS path") + " FROM cls GROUP BY 1, 2)\n"
    + _long("method, path"),
    "db_query_stats": REQ + ", w AS (" + _wide("path AS query", extra=", count(*) FILTER (WHERE status = 500) AS errors")
    + " FROM cls GROUP BY 1)\n" + _long("query", ", errors"),
    "p95_from_buckets": REQ + f""",
w AS ({", ".join(["SELECT count(*) AS total"] + [f"count(*) FILTER (WHERE seconds <= {b}) AS c{i}" for i, b in enumerate(_B)])} FROM cls),
x AS (SELECT {_p95_idx([f"c{i}" for i in range(len(_B))] + ["total"], "total")} AS idx FROM w)
SELECT ([{", ".join(f"'{x}'" for x in _LABELS)}])[idx + 1] AS p95_le, {_p95_ms("idx")} AS p95_ms FROM x""",
    "monitor_snapshots": SNAPSHOTS + "\nSELECT * FROM snap",
    "snapshot_deltas": SNAPSHOTS + """,
top AS (SELECT * FROM snap ORDER BY timestamp DESC LIMIT 40)
SELECT *, coalesce(greatest(0, http_total - lag(http_total) OVER (ORDER BY timestamp)), 0) AS delta_total,
  coalesce(greatest(0, http_5xx - lag(http_5xx) OVER (ORDER BY timestamp)), 0) AS delta_5xx,
  CASE WHEN coalesce(greatest(0, http_total - lag(http_total) OVER (ORDER BY timestamp)), 0) > 0
       THEN coalesce(greatest(0, http_5xx - lag(http_5xx) OVER (ORDER BY timestamp)), 0)
            / coalesce(greatest(0, http_total - lag(http_total) OVER (ORDER BY timestamp)), 0)
       ELSE 0.0 END AS rate_5xx
FROM top""",
    "alert_rules": SNAPSHOTS + f""",
d AS (SELECT *, http_total - lag(http_total) OVER w AS dt, http_5xx - lag(http_5xx) OVER w AS d5,
        db_errors_total - lag(db_errors_total) OVER w AS delta_db_errors,
        sum(CASE WHEN ready_ok = 0 THEN 1 ELSE 0 END) OVER f AS nr, count(*) OVER f AS nn
      FROM snap WINDOW w AS (ORDER BY timestamp),
                       f AS (ORDER BY timestamp ROWS BETWEEN {M.READY_FAIL_CONSEC - 1} PRECEDING AND CURRENT ROW)),
e AS (SELECT *, CASE WHEN dt > 0 THEN round(d5 / dt, 6) ELSE 0.0 END AS rate_5xx FROM d WHERE dt IS NOT NULL),
a AS (SELECT timestamp, rate_5xx, http_p95_ms, delta_db_errors,
        list_filter([CASE WHEN rate_5xx > {M.MAX_5XX_RATE} THEN '5xx_rate_high' END,
                     CASE WHEN http_p95_ms IS NOT NULL AND http_p95_ms > {M.MAX_P95_MS} THEN 'http_p95_high' END,
                     CASE WHEN nn = {M.READY_FAIL_CONSEC} AND nr = {M.READY_FAIL_CONSEC}
                          THEN 'ready_failed_consecutive' END,
                     CASE WHEN delta_db_errors > 0 THEN 'db_errors_increased' END,
                     CASE WHEN ingestion_latest_status IN ('failed', 'partial_failed')
                          THEN 'ingestion_status_bad' END], lambda x: x IS NOT NULL) AS alerts
      FROM e)
SELECT * FROM a WHERE len(alerts) > 0""",
    "inflight_requests": REQ + """,
ev AS (SELECT event_id, ts AS t, 1 AS delta FROM req
       UNION ALL
       SELECT event_id, ts + to_microseconds(CAST(round(seconds * 1000000) AS BIGINT)) AS t, -1 AS delta FROM req),
s AS (SELECT *, sum(delta) OVER (ORDER BY t, delta, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
      FROM ev)
SELECT event_id, t, delta,
  CAST(x - least(0, min(x) OVER (ORDER BY t, delta, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS inflight
FROM s""",
    "status_class": REQ + "\nSELECT status_class, count(*) AS requests FROM cls GROUP BY 1",
    "normalize_path": REQ + "\nSELECT path, path_label, count(*) AS requests FROM cls GROUP BY 1, 2",
}


def _req(spark, sf_dir):
    return TD.requests(spark, sf_dir)


def _snapshots(spark, sf_dir):
    req = _req(spark, sf_dir)
    return M.monitor_snapshots(req, TD.daily_runs(req))


@register("http_request_counts", ORACLE["http_request_counts"])
def http_request_counts(spark, sf_dir):
    """M1: request counts by normalised path, method and status class."""
    return M.http_request_counts(_req(spark, sf_dir))


@register("latency_histogram", ORACLE["latency_histogram"])
def latency_histogram(spark, sf_dir):
    """M2: cumulative latency buckets per (method, path)."""
    return M.latency_histogram(_req(spark, sf_dir)).withColumn("sum_seconds", F.round("sum_seconds", 6))


@register("db_query_stats", ORACLE["db_query_stats"])
def db_query_stats(spark, sf_dir):
    """M3: DB latency buckets and errors per query (query = request path)."""
    return M.db_query_stats(M.db_calls_from_requests(_req(spark, sf_dir))).withColumn(
        "sum_seconds", F.round("sum_seconds", 6))


@register("p95_from_buckets", ORACLE["p95_from_buckets"])
def p95_from_buckets(spark, sf_dir):
    """M4: p95 bucket bound over all paths."""
    return M.p95_from_buckets(M.latency_histogram(_req(spark, sf_dir)))


@register("monitor_snapshots", ORACLE["monitor_snapshots"])
def monitor_snapshots(spark, sf_dir):
    """M5: one snapshot row per 5-minute tick with running totals and the run status at that time."""
    return _snapshots(spark, sf_dir)


@register("snapshot_deltas", ORACLE["snapshot_deltas"])
def snapshot_deltas(spark, sf_dir):
    """M6: newest 40 snapshots with neighbour deltas and 5xx rate."""
    return M.snapshot_deltas(_snapshots(spark, sf_dir))


@register("alert_rules", ORACLE["alert_rules"])
def alert_rules(spark, sf_dir):
    """M7: alerts raised at each snapshot."""
    return M.alert_rules(_snapshots(spark, sf_dir))


@register("inflight_requests", ORACLE["inflight_requests"])
def inflight_requests(spark, sf_dir):
    """M8: in-flight request gauge after each start and end event of the log."""
    return M.inflight_requests(_req(spark, sf_dir))


@register("status_class", ORACLE["status_class"])
def status_class_counts(spark, sf_dir):
    """Requests per status class."""
    return M.classify(_req(spark, sf_dir)).groupBy("status_class").agg(F.count(F.lit(1)).alias("requests"))


@register("normalize_path", ORACLE["normalize_path"])
def normalize_path_counts(spark, sf_dir):
    """Raw path -> metric path label."""
    return (M.classify(_req(spark, sf_dir)).groupBy("path", "path_label")
            .agg(F.count(F.lit(1)).alias("requests")))
