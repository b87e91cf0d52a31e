"""Benchmark: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Phases (each timed):
  load_warehouse  the test tables re-labelled as the price warehouse and
                  written as Parquet (fact partitioned by month, sorted by
                  item and date), as an ingest backfill would leave it;
  queries         the reference's request mix (latest, daily, trend, summary
                  by month, rankings) plus whole-table forms (every item /
                  every date), read from the stored warehouse;
  batch jobs      CSV-row parsing with quarantine, monitoring snapshots.
Each query is run twice and the warm (second) time is reported; results are
fully computed (noop sink), not collected. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seika.operators import ingest as I  # noqa: E402
from seika.operators import monitor as M  # noqa: E402
from seika.operators import prices as R  # noqa: E402
from seika.session import build_session, checkpoint_dir, stage  # noqa: E402
from seika.sources import testdata as TD  # noqa: E402
from seika.sources.warehouse import Warehouse  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
ITEM, FROM, TO, DATE, AS_OF = TD.FIXED_ITEM, "1998-01-01", "1998-12-31", "1998-08-23", TD.FIXED_AS_OF


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, repeat: int = 2) -> float:
    best = None
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    return round(best, 3)


def main() -> None:
    spark = build_session(f"local[{CPUS}]", app_name="seika-bench", shuffle_partitions=max(8, CPUS * 2))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    wh = Warehouse(spark, f"{checkpoint_dir(spark).rstrip('/')}/seika-bench/{uuid.uuid4().hex[:10]}")

    t0 = time.perf_counter()
    wh.write_star(TD.star(spark, SF_DIR, with_row_no=True, materialize=True))
    times["load_warehouse"] = round(time.perf_counter() - t0, 3)
    st = wh.read()

    q = {
        "prices_latest": lambda: R.prices_latest(st, ITEM, limit=20)[0],
        "prices_daily": lambda: R.prices_daily(st, ITEM, from_="1998-12-01", to="1998-12-31", limit=20)[0],
        "prices_trend": lambda: R.prices_trend(st, ITEM, from_="1998-12-01", to="1998-12-31")[0],
        "summary_month": lambda: R.prices_summary(st, ITEM, "month", from_=FROM, to=TO)[0],
        "rank_items": lambda: R.rank_items(st, DATE, "arrival", limit=20)[0],
        "compare_markets": lambda: R.compare_markets(st, DATE, ITEM)[0],
        "dim_items_search": lambda: R.dimension_list(st, "item", q="ring")[0],
        "trend_all_items": lambda: R.prices_trend(st, all_items=True, full_history=True)[0],
        "summary_week_all_items": lambda: R.prices_summary(st, group_by="week", all_items=True, full_history=True)[0],
        "rank_items_all_dates": lambda: R.rank_items(st, metric="arrival", limit=5, all_dates=True)[0],
        "compare_markets_all_items": lambda: R.compare_markets(st, DATE, all_items=True)[0],
        "coverage": lambda: R.coverage(st)[0],
    }
    for name, build in q.items():
        times[name] = timed(lambda b=build: run(b()))

    raw = stage(TD.raw_rows(spark, SF_DIR), "bench-raw")
    times["parse_rows_quarantine"] = timed(lambda: run(I.parse_rows(raw)))
    req = stage(TD.requests(spark, SF_DIR), "bench-requests")
    times["monitor_snapshots"] = timed(lambda: run(M.monitor_snapshots(req)))
    times["latency_histogram"] = timed(lambda: run(M.latency_histogram(req)))

    query_total = round(sum(v for k, v in times.items() if k != "load_warehouse"), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": query_total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": CPUS}))


if __name__ == "__main__":
    main()
