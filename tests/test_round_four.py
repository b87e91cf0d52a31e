"""What the jobs move and how often: texts that travel as one, rows that are numbered once."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from seika.functions.text import pack_texts, unpack_texts
from seika.operators import ingest as I
from seika.operators.numbering import number_rows
from seika.plans import ingest_queries, misc_queries
from seika.sources import testdata as TD

from tests.test_landing import tables

ODD = ["", " ", "a", "\"q\", \\ and \x01\x02\x00", "tab\tline\nreturn\r", "　全角　", "null", "[\"x\"]", " \U0001f600", None]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_texts_come_back_exactly(spark):
    rows = [(i, a, b, "x" * 70_000 if i == 7 else a) for i, (a, b) in enumerate((a, b) for a in ODD for b in ODD)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    back = df.select("i", unpack_texts(pack_texts(["a", "b", "c"])).alias("t")).select("i", *[F.get("t", F.lit(k)) for k in range(3)])
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows


@pytest.mark.parametrize("query", [ingest_queries.fact_upsert, misc_queries.duplicate_key_check])
def test_the_fact_and_the_resent_files_are_numbered_once(spark, tmp_dir, monkeypatch, query):
    sf = tables(spark, f"{tmp_dir}/t")
    numbered = []
    real = TD.number_rows
    monkeypatch.setattr(TD, "number_rows", lambda df, *a, **k: numbered.append(1) or real(df, *a, **k))
    lines = TD.price_rows(spark, sf, with_row_no=False).count()
    rows = query(spark, sf).count()
    assert len(numbered) == 1 and 0 < rows <= lines


def test_numbered_rows_keep_texts_and_lose_what_is_dropped(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randrange(50), *rnd.choices(ODD, k=3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, x string, y string, z string").repartition(5)
    out = number_rows(df, ["g"], ["k", "x"], drop=["k"])
    assert out.columns == ["g", "x", "y", "z", "rn"]
    got = sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[4]))
    order = lambda r: (r[0], r[1], r[2] is not None, (r[2] or "").encode())
    want = sorted(rows, key=order)
    assert [(r[0], r[1]) for r in got] == [(r[0], r[2]) for r in want]
    assert sorted(map(repr, (r[:4] for r in got))) == sorted(repr((r[0], *r[2:])) for r in rows)


def facts(spark, rows, at):
    texts = ("market_code", "item_code", "grade", "trend_label")
    made = [(f, n, *t, p, at, at) for f, n, t, p in rows]
    return spark.createDataFrame(made, "source_file string, source_row_no int, " + ", ".join(f"{c} string" for c in texts)
                                 + ", price_mid_yen int, created_at timestamp, updated_at timestamp")


def test_merged_facts_move_their_texts_as_one_and_keep_repeated_and_null_keys(spark):
    rnd = random.Random(9)
    key = lambda: (rnd.choice(["f1", "f2", "f3", None]), rnd.choice([1, 2, 3, 4, None]))
    old_rows, new_rows = ([(*key(), tuple(rnd.choices(ODD, k=4)), rnd.choice([None, 5, 6])) for _ in range(n)] for n in (40, 12))
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    merged = I.merge_facts(facts(spark, old_rows, t0), facts(spark, new_rows, t1))
    before = plan(merged)  # the first plan, not the adapted one
    want = []
    same = lambda a, b: None not in a[:2] and a[:2] == b[:2]
    for o in old_rows:
        hits = [n for n in new_rows if same(o, n)]
        want += [(*n[:2], *n[2], n[3], t0, t1) for n in hits] or [(*o[:2], *o[2], o[3], t0, t0)]
    want += [(*n[:2], *n[2], n[3], t1, t1) for n in new_rows if not any(same(o, n) for o in old_rows)]
    assert sorted(map(repr, map(tuple, merged.collect()))) == sorted(map(repr, want))
    sides = [x for x in before.splitlines() if " AS _old#" in x or " AS _new#" in x]
    assert before.count("Exchange hashpartitioning") == len(sides) == 2
    assert all("_texts" in x and "market_code, market_code" not in x for x in sides)


def land(folder, rows, files):
    """Daily files of as many rows; every file names the codes otherwise."""
    import os
    from seika.schemas import REQUIRED_HEADERS
    for path in files:
        os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
        with open(f"{folder}/{path}", "w", encoding="utf-8") as f:
            f.write(",".join(REQUIRED_HEADERS) + "\n")
            for i in range(rows):
                row = {"年": "2024", "月": "1", "日": "8", "市場コード": f"M{i % 3}", "市場名": f"m {path} {i}", "品目コード": "I1", "品目名": f"i {path}", "中値": "10"}
                f.write(",".join(row.get(h, "") for h in REQUIRED_HEADERS) + "\n")
    return folder


# "20240108 b/" sorts before "20240108/" as a path, but after it as a date group
FILES = ["20240108/a.csv", "20240108/z.csv", "20240108 b/a.csv", "20240107/100%+ é.csv", "20240107/_x.csv"]


def test_the_newest_name_wins_by_date_group_file_and_row_and_names_are_found_without_files(spark, tmp_dir, monkeypatch):
    plans = []
    real = I.batch_names
    monkeypatch.setattr(I, "batch_names", lambda *a, **k: plans.append(plan(d := real(*a, **k))) or d)
    res = I.ingest_files(spark, land(f"{tmp_dir}/in", 7, FILES), None, now=dt.datetime(2024, 2, 1))
    names = {r.market_code: r.market_name for r in res.star.dim_market.collect()}
    assert names == {"M0": "m20240108b/a.csv6", "M1": "m20240108b/a.csv4", "M2": "m20240108b/a.csv5"}
    assert [r.item_name for r in res.star.dim_item.collect()] == ["i20240108b/a.csv"]
    assert len(plans) == 3 and not any("hashpartitioning" in x and "source_file" in line for x in plans for line in x.splitlines() if "Exchange" in line)
    log = {r.file_path: (r.status, r.rows_ok) for r in res.file_log.collect()}
    assert log == {f: ("success", 7) for f in FILES}
    by_month = {(r.source_file, r.load_month): r["count"] for r in res.star.fact.groupBy("source_file", "load_month").count().collect()}
    assert by_month == {(f, "202401" if " b" not in f else "unknown"): 7 for f in FILES}


def test_a_first_run_publishes_its_rows_without_a_merged_copy(spark, tmp_dir, monkeypatch):
    from seika.sources import warehouse
    stored = []
    real = warehouse.stage
    monkeypatch.setattr(warehouse, "stage", lambda df, name="stage": stored.append(name) or real(df, name))
    wh = warehouse.Warehouse(spark, f"{tmp_dir}/wh")
    root = land(f"{tmp_dir}/in", 5, FILES[:2])
    wh.publish(I.ingest_files(spark, root, None, now=dt.datetime(2024, 2, 1)))
    assert "merged-months" not in stored and wh.read().fact.count() == 10
    wh.publish(I.ingest_files(spark, land(f"{tmp_dir}/in", 6, FILES[1:2]), wh.read(), now=dt.datetime(2024, 2, 2)))
    assert stored.count("merged-months") == 1 and wh.read().fact.count() == 11


def test_paths_are_decoded_once_a_file(spark, tmp_dir):
    from seika.sources import csv_files as C
    root = land(f"{tmp_dir}/in", 5, FILES)
    recs = C.read_records(spark, root, [f"{root}/{f}" for f in FILES])
    assert "decode(" not in plan(recs).lower()
    got = {}
    for r in recs.collect():
        got.setdefault(r.file_path, set()).add(r.record_no)
    assert got == {f: set(range(1, 7)) for f in FILES}


def test_the_other_landed_files_are_made_of_the_days_files(spark, tmp_dir, monkeypatch):
    sf = tables(spark, f"{tmp_dir}/t")
    joined = []
    real = TD._named
    monkeypatch.setattr(TD, "_named", lambda *a: joined.append(1) or real(*a))
    root = TD.landing_csv(spark, sf)
    assert len(joined) == 1
    texts = [open(f, encoding="utf-8").read().splitlines() for f in glob.glob(f"{root}/d=20240113/*.csv")]
    other, day = sorted(texts, key=lambda t: t[0].startswith("動向"))
    remark = ',"a ""quoted"" remark, with \\"'
    want = [",".join(reversed(line.split(",")[1:])) for line in day]  # the columns turned round, without 動向
    assert other == [want[0] + ",備考", *[line + remark for line in want[1:]]] and any(',"",' in line for line in other)


def test_every_white_space_is_trimmed(spark):
    from seika.functions.text import UNICODE_SPACES, trim_unicode
    cores = ["", "x", "x y", "～", "、", "⁠x", "\x00", "\x7f", "é", "﻿x", "　x　y", "\x1f", "!", "~"]
    rows = [(a + c + b, c.strip(UNICODE_SPACES)) for c in cores for a in ("", *UNICODE_SPACES) for b in ("", *UNICODE_SPACES, " 　\x85")]
    out = spark.createDataFrame(rows, "t string, want string").select(trim_unicode("t").alias("got"), "want").collect()
    assert [r for r in out if r.got != r.want] == []
