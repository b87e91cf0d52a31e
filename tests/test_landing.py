"""The landed CSV files and their ingest: same rows as the text rows, and rows that stay where they are when a small table joins them."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from seika.operators import ingest as I
from seika.sources import csv_files as C
from seika.sources import testdata as TD


def tables(spark, folder):
    """Lines on three days, with a part and a supplier that are not there, a nation 0, a null date and a part that comes twice."""
    lines = [(o, p, o % 3, o % 4 + 1, 2.0 + o % 5, 100.0 * o, "ANR"[o % 3], "OF"[o % 2], dt.datetime(2024, 1, day))
             for o in range(1, 13) for p, day in ((o % 5, 7), (o % 4, 13), (1, 8))]
    lines.append((1, 1, 1, 1, 1.0, 1.0, "A", "O", None))
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
                           "l_returnflag string, l_linestatus string, l_shipdate timestamp")
    put("supplier", [(0, "S0"), (1, "S1")], "s_suppkey long, s_name string")
    put("part", [(1, "red box", "B", "T"), (2, "hot ring", "C", "U"), (3, "old cap", "B", "T"), (3, "new cap", "B", "V")],
        "p_partkey long, p_name string, p_brand string, p_type string")
    put("orders", [(o, o % 3) for o in range(1, 10)], "o_orderkey long, o_custkey long")
    put("customer", [(0, 0), (1, 1)], "c_custkey long, c_nationkey int")
    put("nation", [(0, "N0"), (1, "N1")], "n_nationkey int, n_name string")
    return folder


def test_the_landing_holds_the_text_rows_in_file_order_and_numbers_no_ranges(spark, tmp_dir, monkeypatch):
    sf = tables(spark, f"{tmp_dir}/t")
    numbered = []
    real = TD.number_rows
    monkeypatch.setattr(TD, "number_rows", lambda df, *a, **k: numbered.append(df.columns) or real(df, *a, **k))
    raw = TD.raw_rows(spark, sf)
    assert "weekday_ja" not in numbered[0] and "source_file" not in numbered[0]  # made after the numbering
    headers = [c for c in raw.columns if c not in ("source_file", "source_row_no")]
    want = {}
    for r in raw.orderBy("source_file", "source_row_no").collect():
        want.setdefault(r.source_file[:8], []).append({h: r[h] for h in headers})
    assert all(len(rows) > 3 for rows in want.values()) and sorted(want) == ["20240107", "20240108", "20240113"]

    root = TD.landing_csv(spark, sf)
    assert len(numbered) == 1
    recs = C.read_records(spark, root, glob.glob(f"{root}/*/*.csv"))
    got = {}
    for r in recs.orderBy("file_path", "record_no").collect():
        got.setdefault(r.file_path, []).append([x or "" for x in r.fields])
    files = {}
    for path, (head, *rows) in got.items():
        files.setdefault(os.path.dirname(path)[2:], []).append([dict(zip(head, row)) for row in rows])
    key = lambda rows: [tuple(sorted(r.items())) for r in rows]
    for day, rows in want.items():
        main = next(f for f in files[day] if len(f) == len(rows) and "備考" not in f[0])
        # equal keys (the part that comes twice) have no order of their own
        assert sorted(r["品目コード"] for r in main) == sorted(r["品目コード"] for r in rows)
        assert [r["産地コード"] for r in main] == [r["産地コード"] for r in rows] and set(main[0]) - {""} == set(headers)
    assert {d: len(f) for d, f in files.items()} == {"20240107": 2, "20240108": 1, "20240113": 2}
    other = next(f for f in files["20240113"] if "備考" in f[0])
    assert len(other) == len(want["20240113"]) and "動向" not in other[0] and {r["備考"] for r in other} == {'a "quoted" remark, with \\'}
    poison = [f for f in files["20240107"] if len(f) == 1]
    assert [r["市場コード"] for r in poison[0]] == [TD.POISON_CODE] and key(poison[0])


@pytest.fixture
def few_bytes(spark):
    """Broadcasts stay below 60 KB."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(60 << 10))
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _land(tmp_dir, rows):
    from seika.schemas import REQUIRED_HEADERS
    import random
    rnd = random.Random(5)
    for day in ("20240108", "20240109"):
        os.makedirs(f"{tmp_dir}/in/{day}")
        with open(f"{tmp_dir}/in/{day}/a.csv", "w", encoding="utf-8") as f:
            f.write(",".join(REQUIRED_HEADERS) + "\n")
            for i in range(rows):
                row = {"年": "2024", "月": "1", "日": day[-1], "市場コード": "M1", "市場名": "m", "品目コード": "I1", "品目名": "i", "中値": "10"}
                f.write(",".join(row.get(h, f"{rnd.getrandbits(64):x}" if h in ("品名", "等級", "階級") else "") for h in REQUIRED_HEADERS) + "\n")
    return f"{tmp_dir}/in"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_stay_where_they_are_when_headers_join_them(spark, tmp_dir, few_bytes):
    root = _land(tmp_dir, 3000)
    recs = C.read_records(spark, root, sorted(glob.glob(f"{root}/*/*.csv")))
    rows, merged = C.labelled_rows(recs, C.header_maps(recs)), C.merge_daily(recs)
    for df in (rows, merged.groupBy("date_key").agg(F.count("品目名"))):
        assert "SortMergeJoin" not in _plan(df) and "ShuffledHashJoin" not in _plan(df)
    assert rows.count() == merged.count() == 6000


def test_parsed_rows_stay_where_they_are_in_a_first_ingest(spark, tmp_dir, few_bytes):
    res = I.ingest_files(spark, _land(tmp_dir, 3000), None, now=dt.datetime(2024, 2, 1))
    assert "Exchange hashpartitioning" not in _plan(res.star.fact)
    assert res.star.fact.count() == 6000 and {r.created_at for r in res.star.fact.select("created_at").distinct().collect()} == {dt.datetime(2024, 2, 1)}
