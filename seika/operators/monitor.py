"""Request-log monitoring as aggregations over request events (M1-M8).

The reference keeps counters and histograms in process memory and derives
snapshots and alerts with shell and browser arithmetic; here the same numbers
come from one table of request events (ts, method, path, status, seconds).
Everything aggregates first; the only ordered windows run over the small
per-tick table (one row per 5-minute tick) or use the bucketed running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seika.functions.http import normalize_path, status_class
from seika.operators.numbering import BLOCK_ROWS, running, with_rows_before
from seika.session import stage

# Histogram bucket bounds (seconds) and their labels ("%g").
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]
BUCKET_LABELS = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10", "+Inf"]
# Snapshot and alert parameters.
TICK = "5 minutes"
P95_INF_MS = 10000
MAX_5XX_RATE = 0.02
MAX_P95_MS = 800
READY_FAIL_CONSEC = 3
RECENT_ROWS = 40
BAD_RUN_STATUSES = ["failed", "partial_failed"]


def classify(requests: DataFrame) -> DataFrame:
    """S11 + S12 on a request log."""
    return requests.withColumns({"path_label": normalize_path(F.col("path")),
                                 "status_class": status_class(F.col("status"))})


def http_request_counts(requests: DataFrame) -> DataFrame:
    """M1: requests per (normalised path, method, status class)."""
    return (classify(requests).groupBy(F.col("path_label").alias("path"), "method", "status_class")
            .agg(F.count(F.lit(1)).alias("requests")))


def _bucket_aggs(value: Column) -> list[Column]:
    aggs = [F.count_if(value <= F.lit(b)).alias(f"_le{i}") for i, b in enumerate(BUCKETS)]
    return aggs + [F.count(F.lit(1)).alias(f"_le{len(BUCKETS)}"), F.sum(value).alias("sum_seconds")]


def _long_buckets(wide: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(lbl).alias("le"),
                               F.col(f"_le{i}").alias("cumulative_count"))
                      for i, lbl in enumerate(BUCKET_LABELS)])
    return (wide.select(*keys, *extra, "sum_seconds", F.col(f"_le{len(BUCKETS)}").alias("observations"),
                        F.inline(pairs)))


def latency_histogram(requests: DataFrame) -> DataFrame:
    """M2: cumulative ``le`` bucket counts, sum and count of latency per
    (method, normalised path), long form (one row per bucket)."""
    wide = classify(requests).groupBy("method", F.col("path_label").alias("path")).agg(
        *_bucket_aggs(F.col("seconds")))
    return _long_buckets(wide, ["method", "path"])


def db_query_stats(db_calls: DataFrame) -> DataFrame:
    """M3: the same histogram per DB query name, with the error count.
    ``db_calls`` has (query, seconds, error)."""
    wide = db_calls.groupBy("query").agg(*_bucket_aggs(F.col("seconds")),
                                        F.count_if(F.col("error")).alias("errors"))
    return _long_buckets(wide, ["query"], ["errors"])


def _p95_from_cumulative(cum: list[Column], total: Column) -> Column:
    """First bound whose cumulative count reaches 95% of the total; the bucket
    index (0..11), NULL without data."""
    target = total * F.lit(0.95)
    out = F.lit(len(BUCKET_LABELS) - 1)
    for i in range(len(cum) - 1, -1, -1):
        out = F.when(cum[i] >= target, F.lit(i)).otherwise(out)
    return F.when(total > 0, out)


def _p95_ms(idx: Column) -> Column:
    ms = F.lit(None).cast("bigint")
    for i, b in enumerate(BUCKETS):
        ms = F.when(idx == i, F.lit(int(round(b * 1000)))).otherwise(ms)
    return F.when(idx == len(BUCKETS), F.lit(P95_INF_MS)).otherwise(ms)


def p95_from_buckets(histogram: DataFrame) -> DataFrame:
    """M4: sum the buckets of every (method, path); the first ``le`` whose
    count reaches 0.95 x total, in ms (``+Inf`` -> 10000, no data -> NULL).
    A bucket bound, not a percentile estimate."""
    per = histogram.groupBy("bucket").agg(F.sum("cumulative_count").alias("c"))
    wide = per.agg(*[F.sum(F.when(F.col("bucket") == i, F.col("c"))).alias(f"_c{i}")
                     for i in range(len(BUCKET_LABELS))])
    cum = [F.coalesce(F.col(f"_c{i}"), F.lit(0)) for i in range(len(BUCKET_LABELS))]
    idx = _p95_from_cumulative(cum, cum[-1])
    labels = F.array(*[F.lit(x) for x in BUCKET_LABELS])
    # explicit NULL guard: element_at on a literal array does not give NULL for a NULL index
    return wide.select(F.when(idx.isNotNull(), F.element_at(labels, idx + 1)).alias("p95_le"),
                       _p95_ms(idx).cast("int").alias("p95_ms"))


def db_calls_from_requests(requests: DataFrame) -> DataFrame:
    """The DB calls seen with each request: query = path, error when status 500."""
    return requests.select("ts", F.col("path").alias("query"), "seconds",
                           (F.col("status") == 500).alias("error"))


def tick_counts(requests: DataFrame, tick: str = TICK) -> DataFrame:
    """Per-tick partial counts of M5 (one row per tick holding requests):
    requests, 5xx, DB errors, whether a ``/ready`` failed, and the latency
    bucket counts. Works on a batch or a streaming request log."""
    r = classify(requests)
    return (r.groupBy(F.window("ts", tick).alias("w"))
             .agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(F.col("status_class") == "5xx").alias("n5xx"),
                  F.count_if(F.col("status") == 500).alias("ndb"),
                  F.max((F.col("path") == "/ready") & (F.col("status") >= 500)).alias("ready_failed"),
                  *[F.count_if(F.col("seconds") <= F.lit(b)).alias(f"_le{i}") for i, b in enumerate(BUCKETS)])
             .select(F.col("w.end").alias("tick_end"), "*").drop("w"))


def db_errors_per_tick(db_calls: DataFrame, tick: str = TICK) -> DataFrame:
    """(tick_end, ndb): failed calls of a DB call log (ts, error) per tick."""
    return (db_calls.where(F.col("error")).groupBy(F.window("ts", tick).alias("w"))
            .agg(F.count(F.lit(1)).alias("ndb")).select(F.col("w.end").alias("tick_end"), "ndb"))


def every_tick(t: DataFrame, tick: str = TICK) -> DataFrame:
    """The tick table with a row for every tick between the first and the last:
    ticks without a request have zero counts and a ready service."""
    bounds = t.agg(F.min("tick_end").alias("lo"), F.max("tick_end").alias("hi")).where("lo IS NOT NULL")
    grid = bounds.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {tick}"))).alias("tick_end"))
    counts = [c for c in t.columns if c not in ("tick_end", "ready_failed")]
    return (grid.join(t, "tick_end", "left").na.fill(0, counts)
            .withColumn("ready_failed", F.coalesce("ready_failed", F.lit(False))))


def status_at_ticks(t: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``run_status``: the status, at the tick's end, of the newest run
    started by then: its final one if it has finished, else ``running``;
    ``unknown`` before the first run.

    Runs and finishes are put between the ticks as events and carried forward.
    One row per tick and per run: sizes that follow the time span and the
    schedule, not the request volume."""
    started = runs.select(F.col("started_at").alias("at"), "id", F.lit("running").alias("s"), F.lit(0).alias("o"))
    ended = runs.where("finished_at IS NOT NULL").select(F.col("finished_at").alias("at"), "id", F.col("status").alias("s"), F.lit(1).alias("o"))
    ticks = t.select(F.col("tick_end").alias("at"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("s"), F.lit(2).alias("o"))
    # a tick's id is null; at equal times starts come first, then ends, then the tick
    known = running(started.unionByName(ended).unionByName(ticks), ["at", "o", "id"],
                    maxima={"newest": F.when(F.col("id").isNotNull(), F.struct("id", "o", "s"))})
    known = known.where("o = 2").select(F.col("at").alias("tick_end"), F.col("newest.s").alias("run_status"))
    return t.join(known, "tick_end").withColumn("run_status", F.coalesce("run_status", F.lit("unknown")))


def snapshots_from_ticks(t: DataFrame, runs: DataFrame | None = None, tick: str = TICK) -> DataFrame:
    """M5 from the tick table: running totals over all ticks, the p95 bound of all latencies so far, readiness and run status."""
    sums = {"http_total": "n", "http_5xx": "n5xx", "db_errors_total": "ndb",
            **{f"_cum{i}": f"_le{i}" for i in range(len(BUCKETS))}}
    # the request log is aggregated once: the grid of ticks and the totals read the stored counts
    t = running(every_tick(stage(t, "ticks"), tick), ["tick_end"], sums)
    cum = [F.col(f"_cum{i}") for i in range(len(BUCKETS))] + [F.col("http_total")]
    idx = _p95_from_cumulative(cum, F.col("http_total"))
    t = t.withColumn("run_status", F.lit("unknown")) if runs is None else status_at_ticks(t, runs)
    return t.select(
        F.date_format("tick_end", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(F.col("ready_failed"), 0).otherwise(1).alias("ready_ok"),
        F.col("http_total").cast("bigint").alias("http_total"),
        F.col("http_5xx").cast("bigint").alias("http_5xx"),
        F.col("db_errors_total").cast("bigint").alias("db_errors_total"),
        _p95_ms(idx).cast("int").alias("http_p95_ms"),
        F.col("run_status").alias("ingestion_latest_status"))


def monitor_snapshots(requests: DataFrame, runs: DataFrame | None = None,
                      tick: str = TICK, db_calls: DataFrame | None = None) -> DataFrame:
    """M5: one snapshot per tick from the first to the last one holding
    requests, empty ticks included: readiness (0 when the tick has a failed
    ``/ready``), running totals of requests, 5xx and DB errors, the p95 bound of
    all latencies so far, and the status of the newest run at that time
    (``unknown`` when there is none).

    DB errors are the failed calls of ``db_calls`` (ts, error); without such a
    log a status of 500 counts as one. Per-tick partial counts are aggregated
    first; the running totals then run over the tick table.
    """
    t = tick_counts(requests, tick)
    if db_calls is not None:
        t = t.drop("ndb").join(db_errors_per_tick(db_calls, tick), "tick_end", "full")
        t = t.na.fill(0, [c for c in t.columns if c not in ("tick_end", "ready_failed")])
    return snapshots_from_ticks(t, runs, tick)


def snapshot_deltas(snapshots: DataFrame, recent: int = RECENT_ROWS) -> DataFrame:
    """M6: the newest ``recent`` snapshots with deltas to the next older one in
    that slice: max(0, d total), max(0, d 5xx), rate = d5xx / dtotal or 0. The
    slice is cut first (top-k), so the window runs over ``recent`` rows."""
    top = snapshots.orderBy(F.col("timestamp").desc()).limit(recent)
    w = Window.orderBy("timestamp")
    d_total = F.greatest(F.lit(0), F.col("http_total") - F.lag("http_total").over(w))
    d_5xx = F.greatest(F.lit(0), F.col("http_5xx") - F.lag("http_5xx").over(w))
    out = top.select("*", F.coalesce(d_total, F.lit(0)).alias("delta_total"),
                     F.coalesce(d_5xx, F.lit(0)).alias("delta_5xx"))
    return out.withColumn("rate_5xx", F.when(F.col("delta_total") > 0,
                                             F.col("delta_5xx") / F.col("delta_total")).otherwise(F.lit(0.0)))


def alert_rules(snapshots: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """M7: per snapshot with a predecessor: 5xx rate (of unclamped deltas,
    0 unless requests grew, compared at 6 decimals) > 0.02; p95 > 800 ms; the 3
    newest samples all not ready; DB errors grew; latest run failed. Only
    snapshots with at least one alert are returned.

    The lag and 3-row frames look two rows back: blocks of consecutive snapshots
    start with the last two of the block before, so no task orders the whole table."""
    s = snapshots.withColumn("_ts", F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    s = with_rows_before(s, ["_ts"], READY_FAIL_CONSEC - 1, block_rows)
    w = Window.partitionBy("_block").orderBy("_no")
    prev_total, prev_5xx, prev_db = (F.lag(c).over(w) for c in ("http_total", "http_5xx", "db_errors_total"))
    frame = w.rowsBetween(-(READY_FAIL_CONSEC - 1), 0)
    s = s.select("*", (F.col("http_total") - prev_total).alias("delta_total"),
                 (F.col("http_5xx") - prev_5xx).alias("delta_5xx"),
                 (F.col("db_errors_total") - prev_db).alias("delta_db_errors"),
                 F.sum(F.when(F.col("ready_ok") == 0, 1).otherwise(0)).over(frame).alias("_not_ready"),
                 F.count(F.lit(1)).over(frame).alias("_n"))
    s = s.where(F.col("_own") & F.col("delta_total").isNotNull())
    rate = F.when(F.col("delta_total") > 0, F.round(F.col("delta_5xx") / F.col("delta_total"), 6)) \
            .otherwise(F.lit(0.0))
    alerts = F.array(
        F.when(rate > MAX_5XX_RATE, F.lit("5xx_rate_high")),
        F.when(F.col("http_p95_ms").isNotNull() & (F.col("http_p95_ms") > MAX_P95_MS), F.lit("http_p95_high")),
        F.when((F.col("_n") == READY_FAIL_CONSEC) & (F.col("_not_ready") == READY_FAIL_CONSEC),
               F.lit("ready_failed_consecutive")),
        F.when(F.col("delta_db_errors") > 0, F.lit("db_errors_increased")),
        F.when(F.col("ingestion_latest_status").isin(*BAD_RUN_STATUSES), F.lit("ingestion_status_bad")))
    out = s.select("timestamp", rate.alias("rate_5xx"), "http_p95_ms", "delta_db_errors",
                   F.filter(alerts, lambda a: a.isNotNull()).alias("alerts"))
    return out.where(F.size("alerts") > 0)


def inflight_requests(requests: DataFrame) -> DataFrame:
    """M8: concurrent requests after every start (+1) and end (-1) event."""
    return gauge(request_events(requests))


def request_events(requests: DataFrame) -> DataFrame:
    """(event_id, t, delta): a start and an end event of each request."""
    starts = requests.select("event_id", F.col("ts").alias("t"), F.lit(1).alias("delta"))
    ends = requests.select("event_id", (F.col("ts") + F.make_dt_interval(
        secs=F.col("seconds").cast("decimal(18,6)"))).alias("t"), F.lit(-1).alias("delta"))
    return starts.unionByName(ends)


def gauge(events: DataFrame) -> DataFrame:
    """The gauge over (event_id, t, delta) events; at equal times ends come
    before starts. It is reset to 0 whenever it would fall below (an end whose
    start is missing) and goes on from there, as the reference's does: the
    running sum minus its least value so far (0 at most). Summed by time ranges,
    so no single task orders the whole log."""
    out = running(events, ["t", "delta", "event_id"], {"inflight": "delta"}, minima={"_least": "inflight"})
    return out.withColumn("inflight", (F.col("inflight") - F.least(F.lit(0), F.col("_least"))).cast("bigint")).drop("_least")
