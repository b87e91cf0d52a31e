"""Hand-made CSV batches for what the table views cannot show (FIXTURES §4)."""

import csv
import datetime as dt
import hashlib
import os

from pyspark.sql import functions as F

from seika.operators import ingest as I
from seika.schemas import REQUIRED_HEADERS
from seika.sources.warehouse import Warehouse

H = REQUIRED_HEADERS
NOW = dt.datetime(2024, 1, 2, 3, 4, 5)


def row(**kw):
    base = {"年": "2024", "月": "1", "日": "5", "曜日": "金", "市場名": "東京", "市場コード": "13",
            "品目名": "だいこん", "品目コード": "30100", "産地名": "千葉", "産地コード": "12",
            "品目計": "1,234.5", "入荷量": "10.25", "高値": "120", "中値": "100", "安値": "80",
            "等級": "秀", "階級": "L", "品名": "", "量目": "10kg", "動向": ""}
    base.update(kw)
    return base


def write_csv(path, header, rows, bom=False, newline_at_end=True, raw=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if raw is not None:
        data = raw
    else:
        def q(v):
            return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
        lines = [",".join(q(h) for h in header)] + [",".join(q(r.get(h, "")) for h in header) for r in rows]
        data = "\n".join(lines) + ("\n" if newline_at_end else "")
    with open(path, "wb") as f:
        f.write((b"\xef\xbb\xbf" if bom else b"") + data.encode("utf-8"))


def ingest(spark, root, existing=None):
    return I.ingest_files(spark, root, existing, run_type="test", now=NOW)


def test_header_mapping_bom_dupes_short_rows(spark, tmp_dir):
    root = f"{tmp_dir}/utf8"
    r = row()
    hdr = list(reversed(H)) + ["市場名"]                       # reordered, and a duplicate that wins
    vals = [r[h] for h in reversed(H)] + ["大阪"]
    write_csv(f"{root}/20240105/a.csv", None, None, bom=True,
              raw=",".join(hdr) + "\n" + ",".join('"' + v + '"' if "," in v else v for v in vals) + "\n")
    # b: full header, a blank line, then a short record (fields after 品目コード missing -> '')
    short = ",".join(["2024", "1", "5", "金", "東京", "13", "かぶ", "30200"])
    write_csv(f"{root}/20240105/b.CSV", None, None, raw=",".join(H) + "\n\n" + short + "\n")
    write_csv(f"{root}/20240105/c.csv", None, None, raw=",".join(H[:8]) + "\n" + short + "\n")
    res = ingest(spark, root)
    parsed = {r.source_file: r for r in res.parsed.collect()}
    assert parsed["20240105/a.csv"].market_name == "大阪"
    b = parsed["20240105/b.CSV"]
    assert (b.source_row_no, b.origin_code, b.origin_name, b.item_total_ton, b.reject_reason) == \
        (2, "UNKNOWN", "不明", None, None)
    log = {r.file_path: r for r in res.file_log.collect()}
    assert log["20240105/c.csv"].status == "failed"            # header lacks required columns
    assert log["20240105/c.csv"].rows_total == 0
    assert log["20240105/a.csv"].status == "success" and log["20240105/b.CSV"].status == "success"
    # the newest (file, row) of the batch names the market: b.CSV sorts after a.csv
    assert {r.market_code: r.market_name for r in res.star.dim_market.collect()} == {"13": "東京"}
    a = [x for x in res.star.fact.collect() if x.source_file == "20240105/a.csv"][0]
    assert float(a.item_total_ton) == 1234.5 and a.source_row_no == 2


def test_rules_quoted_newline_and_quarantine(spark, tmp_dir):
    root = f"{tmp_dir}/utf8"
    rows = [row(動向="やや\n高"), row(月="13"), row(市場コード="　"), row(中値="abc"), row(入荷量="-1"),
            row(品目名=" 　"), row(産地コード="", 産地名=""), row(中値="99.9"), row(安値="-0.4")]
    write_csv(f"{root}/20240105/all_20240105.csv", H, rows)
    res = ingest(spark, root)
    log = res.file_log.collect()[0]
    assert (log.rows_total, log.rows_ok, log.rows_error, log.status) == (9, 4, 5, "partial_success")
    rej = {r.source_row_no: r.reject_reason for r in res.rejects.collect()}
    assert rej == {3: "invalid date", 4: "missing required codes", 5: "invalid 中値", 6: "invalid 入荷量: negative",
                   7: "missing required names"}
    fact = {r.source_row_no: r for r in res.star.fact.collect()}
    assert fact[2].trend_label == "やや\n高"
    assert (fact[8].origin_code, 1) == ("UNKNOWN", 1)
    assert fact[9].price_mid_yen == 99 and fact[10].price_low_yen == 0
    origins = {r.origin_code: r.origin_name for r in res.star.dim_origin.collect()}
    assert origins["UNKNOWN"] == "不明"
    run = res.run.collect()[0]
    assert run.status == "success"                               # rejected rows alone keep the run successful


def test_group_atomicity_overflow_and_empty_file(spark, tmp_dir):
    root = f"{tmp_dir}/utf8"
    write_csv(f"{root}/20240105/a.csv", H, [row()])
    write_csv(f"{root}/20240105/b.csv", H, [row(高値="3000000000")])        # INT overflow -> group fails
    write_csv(f"{root}/20240106/a.csv", H, [row(日="6", 入荷量="123456789012.5")])  # NUMERIC(14,3) overflow
    write_csv(f"{root}/20240107/a.csv", H, [row(日="7", 市場コード="C" * 33)])   # over-length code
    write_csv(f"{root}/20240108/a.csv", H, [row(日="8")])
    write_csv(f"{root}/20240108/empty.csv", H, [], raw="")
    res = ingest(spark, root)
    log = {r.file_path: r.status for r in res.file_log.collect()}
    assert log == {"20240105/a.csv": "failed", "20240105/b.csv": "failed", "20240106/a.csv": "failed",
                   "20240107/a.csv": "failed", "20240108/a.csv": "success", "20240108/empty.csv": "failed"}
    assert [r.source_file for r in res.star.fact.collect()] == ["20240108/a.csv"]
    assert res.run.collect()[0].status == "partial_failed"


def test_republish_is_idempotent_and_never_deletes(spark, tmp_dir):
    root = f"{tmp_dir}/utf8"
    wh = Warehouse(spark, f"{tmp_dir}/wh")
    write_csv(f"{root}/20240105/a.csv", H, [row(), row(中値="110"), row(中値="120")])
    wh.publish(ingest(spark, root, wh.read()))
    first = sorted((r.source_row_no, r.price_mid_yen) for r in wh.read().fact.collect())
    wh.publish(ingest(spark, root, wh.read()))                                # same file again
    again = wh.read()
    assert sorted((r.source_row_no, r.price_mid_yen) for r in again.fact.collect()) == first
    assert again.dim_market.count() == 1 and again.runs.count() == 2
    # a shorter re-send with a changed value: row 2 updated, row 4 kept
    write_csv(f"{root}/20240105/a.csv", H, [row(中値="105"), row(中値="110")])
    wh.publish(ingest(spark, root, wh.read()))
    last = wh.read()
    assert sorted((r.source_row_no, r.price_mid_yen) for r in last.fact.collect()) == [(2, 105), (3, 110), (4, 120)]
    ids = [r.id for r in last.files.orderBy("id").collect()]
    assert ids == [1, 2, 3]
    created = {r.source_row_no: r.created_at for r in last.fact.collect()}
    assert len(set(created.values())) == 1


def test_a_file_with_an_overlong_record_fails_alone(spark, tmp_dir):
    root = f"{tmp_dir}/utf8"
    write_csv(f"{root}/20240105/a.csv", H, [row()])
    write_csv(f"{root}/20240105/b.csv", H, [], raw=",".join(H) + "\n" + "," * 100_001 + "\n")
    write_csv(f"{root}/20240106/_c.csv", H, [], raw=",".join(H) + "\n" + "," * 100_001 + "\n")
    for day in range(7, 10):
        write_csv(f"{root}/2024010{day}/a.csv", H, [row(日=str(day)), row(日=str(day), 中値="110")])
    res = ingest(spark, root)
    log = {r.file_path: (r.status, r.error, len(r.file_hash)) for r in res.file_log.collect()}
    wide = ("failed", "read file: a record has too many fields", 64)
    good = ("success", None, 64)
    assert log == {"20240105/a.csv": good, "20240105/b.csv": wide, "20240106/_c.csv": wide,
                   **{f"2024010{d}/a.csv": good for d in range(7, 10)}}
    assert res.star.fact.count() == 7 and res.run.collect()[0].status == "partial_failed"


def test_no_files_is_skipped(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/utf8/20240109", exist_ok=True)
    assert ingest(spark, f"{tmp_dir}/utf8") is None


def test_sjis_decoding(spark):
    from seika.sources.encoding import sjis_to_utf8
    good = "髙①㈱だいこん".encode("cp932")
    df = spark.createDataFrame([(bytearray(good),), (bytearray(b"\x82\xa0\xff\x82"),)], "b binary")
    got = [r[0] for r in df.select(sjis_to_utf8("b")).collect()]
    assert got[0] == "髙①㈱だいこん"
    assert got[1].startswith("あ") and "�" in got[1]
    bom = df.limit(1).select(sjis_to_utf8("b", add_bom=True)).collect()[0][0]
    assert bom.startswith("﻿")
    assert F is not None


def test_publish_rewrites_only_touched_partitions(spark, tmp_dir):
    wh = Warehouse(spark, f"{tmp_dir}/wh")
    jan, feb = f"{tmp_dir}/in_jan", f"{tmp_dir}/in_feb"
    write_csv(f"{jan}/20240105/a.csv", H, [row(), row(中値="110")])
    wh.publish(ingest(spark, jan, wh.read()))
    january = sorted(os.listdir(f"{tmp_dir}/wh/fact_prices_daily/load_month=202401"))
    write_csv(f"{feb}/20240203/a.csv", H, [row(月="2", 日="3")])
    res = ingest(spark, feb, wh.read())
    assert res.touched == ["202402"]
    wh.publish(res)
    assert sorted(os.listdir(f"{tmp_dir}/wh/fact_prices_daily/load_month=202401")) == january          # January's files were not rewritten
    st = wh.read()
    assert sorted(r.load_month for r in st.fact.select("load_month").distinct().collect()) == ["202401", "202402"]
    assert st.fact.count() == 3 and st.runs.count() == 2


def test_merge_daily_by_header_name(spark, tmp_dir):
    from seika.sources import csv_files as C
    root = f"{tmp_dir}/utf8"
    write_csv(f"{root}/20240105/b.csv", list(reversed(H)), [row(中値="2"), row(中値="3")], newline_at_end=False)
    write_csv(f"{root}/20240105/a.csv", H, [row(中値="1")])
    write_csv(f"{root}/20240105/all_20240105.csv", H, [row(中値="999")])        # an earlier merge: left out
    listing = C.list_files(spark, root)
    recs = C.read_records(spark, root, [r.abs_path for r in listing.collect()])
    merged = C.merge_daily(recs)
    assert [r["中値"] for r in merged.collect()] == ["1", "2", "3"]
    C.write_merged_daily(merged, f"{tmp_dir}/merged")
    back = spark.read.option("header", "true").csv(f"{tmp_dir}/merged/20240105/all_20240105.csv")
    assert back.count() == 3 and back.columns == H


def test_merge_keeps_every_file_and_column(spark, tmp_dir):
    """Files without all required headers are merged too, and columns of their own stay."""
    from seika.sources import csv_files as C
    root = f"{tmp_dir}/utf8"
    write_csv(f"{root}/20240105/a.csv", H[:3] + ["備考"], [dict(row(), 備考='says "so", twice\\')])
    write_csv(f"{root}/20240105/_b.csv", H[3:], [row(), row()])
    write_csv(f"{root}/20240106/c.csv", H, [row()])
    paths = [r.abs_path for r in C.list_files(spark, root).collect()]
    merged = C.merge_daily(C.read_records(spark, root, paths))
    C.write_merged_daily(merged, f"{tmp_dir}/merged", delete_sources=paths[:1])
    with open(f"{tmp_dir}/merged/20240105/all_20240105.csv", encoding="utf-8") as f:
        got = list(csv.DictReader(f))
    assert len(got) == 3 and set(got[0]) == {*H, "備考"}
    assert [r["備考"] for r in got] == ["", "", 'says "so", twice\\']            # _b.csv sorts first
    assert got[0]["市場名"] == "東京" and got[2]["市場名"] == "" and got[2]["年"] == "2024"
    assert os.path.exists(f"{tmp_dir}/merged/20240106/all_20240106.csv")
    assert [os.path.exists(p) for p in paths] == [False, True, True]


def test_quotes_backslashes_and_stray_quotes(spark, tmp_dir):
    from seika.sources import csv_files as C
    root = f"{tmp_dir}/utf8"
    lines = ["h1,h2,h3", '"a""b, c",x,y', '"back\\",x,y', '"a"b",x,y', 'a"b,x"y,"z"', '"two\nlines",,""', "", "last,1,2"]
    write_csv(f"{root}/20240105/a.csv", None, None, raw="\n".join(lines) + "\n")
    recs = C.read_records(spark, root, [r.abs_path for r in C.list_files(spark, root).collect()])
    got = [(r.record_no, [x or "" for x in r.fields[:3]]) for r in recs.orderBy("record_no").collect()]
    assert got == [(1, ["h1", "h2", "h3"]), (2, ['a"b, c', "x", "y"]), (3, ["back\\", "x", "y"]), (4, ['a"b', "x", "y"]),
                   (5, ['a"b', 'x"y', "z"]), (6, ["two\nlines", "", ""]), (7, ["last", "1", "2"])]


def test_wide_headers_and_hidden_names(spark, tmp_dir):
    """A required header may stand in column 140; names may begin with _ or a dot."""
    from seika.sources import csv_files as C
    root = f"{tmp_dir}/utf8"
    extra = [f"extra{i}" for i in range(120)]
    write_csv(f"{root}/20240105/wide.csv", extra + H, [dict(row(), **{e: "v" for e in extra})])
    write_csv(f"{root}/20240105/_b.csv", H, [row(中値="7")])
    write_csv(f"{root}/_20240106/c.CSV", H, [row()])
    write_csv(f"{root}/20240105/.d e.csv", H, [row(中値="8")])
    os.symlink(f"{root}/20240105/wide.csv", f"{root}/20240105/link.csv")
    listing = C.list_files(spark, root).collect()
    assert [r.file_path for r in listing] == ["20240105/.d e.csv", "20240105/_b.csv", "20240105/wide.csv", "_20240106/c.CSV"]
    res = ingest(spark, root)
    assert {(r.file_path, r.status, r.rows_ok) for r in res.file_log.collect()} == {(r.file_path, "success", 1) for r in listing}
    assert {r.source_file: r.price_mid_yen for r in res.parsed.collect()} == {
        "20240105/.d e.csv": 8, "20240105/_b.csv": 7, "20240105/wide.csv": 100, "_20240106/c.CSV": 100}


def test_row_numbers_do_not_depend_on_parallelism(spark, tmp_dir):
    from seika.sources import csv_files as C
    root = f"{tmp_dir}/utf8"
    for i in range(9):
        write_csv(f"{root}/20240105/f{i}.csv", H, [row(中値=str(100 * i + j)) for j in range(5 + i)])
    paths = [r.abs_path for r in C.list_files(spark, root).collect()]
    got = []
    for n in ("2", "64"):
        spark.conf.set("spark.sql.files.minPartitionNum", n)
        try:
            recs = C.read_records(spark, root, paths)
            got.append(sorted((r.file_path, r.record_no, r.fields[13]) for r in recs.collect()))
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got[0] == got[1] and max(r[1] for r in got[0]) == 14


def test_unreadable_file_fails_alone_and_long_names_poison(spark, tmp_dir):
    root = f"{tmp_dir}/utf8"
    write_csv(f"{root}/20240105/a.csv", H, [row()])
    write_csv(f"{root}/20240106/gone.csv", H, [row()])
    from seika.sources import csv_files as C
    listing = C.list_files(spark, root).withColumn("abs_path", F.regexp_replace("abs_path", "gone", "none"))
    hashes = {r.file_path: r for r in C.file_hashes(listing).collect()}
    with open(f"{root}/20240105/a.csv", "rb") as f:
        assert hashes["20240105/a.csv"].file_hash == hashlib.sha256(f.read()).hexdigest()
    assert hashes["20240106/gone.csv"].file_hash is None and hashes["20240106/gone.csv"].read_error
    raw = spark.createDataFrame([tuple(row().values()) + ("x" * 1025, 2)], [*row(), "source_file", "source_row_no"])
    assert I.parse_rows(raw).first().load_error == "value too long for source_file"


def test_read_sjis_files(spark, tmp_dir):
    from seika.sources.encoding import read_sjis_files
    os.makedirs(f"{tmp_dir}/raw", exist_ok=True)
    with open(f"{tmp_dir}/raw/x.csv", "wb") as f:
        f.write("年,市場名\n2024,髙①㈱市場\n".encode("cp932"))
    got = read_sjis_files(spark, f"{tmp_dir}/raw", add_bom=True).collect()
    assert len(got) == 1 and got[0].text == "﻿年,市場名\n2024,髙①㈱市場\n"


def test_headers_of_any_width_with_blank_cells_anywhere(spark, tmp_dir):
    """63 names and a blank before the required ones; 70 cells with blanks at the end; 3,000 cells; a quoted separator and a line break in a header."""
    from seika.sources import csv_files as C

    root = f"{tmp_dir}/utf8"
    wide = [f"x{i}" for i in range(63)] + [""] + H
    many = [f"y{i}" for i in range(2980)] + H
    odd = ['one, "two"', "three\nfour", "", *H, "", "", ""]
    for name, header in (("a", wide), ("b", many), ("c", odd), ("d", H)):
        lines = [",".join('"' + h.replace('"', '""') + '"' if any(c in h for c in ',"\n') else h for h in header),
                 ",".join("" if h not in row() else '"' + row()[h] + '"' for h in header), ""]
        write_csv(f"{root}/20240105/{name}.csv", None, None, raw="\n" + "\n".join(lines))
    paths = [f"{root}/20240105/{n}.csv" for n in "abcd"]
    assert C.header_width(spark, paths) >= 3000
    res = ingest(spark, root)
    assert [r.status for r in res.star.files.collect()] == ["success"] * 4
    assert res.star.fact.count() == 4
    records = C.read_records(spark, root, paths)
    assert {r["file_path"][-5]: r["n"] for r in records.where("record_no = 1").selectExpr("file_path", "size(filter(fields, x -> trim(x) <> '')) AS n").collect()} == {
        "a": 83, "b": 3000, "c": 22, "d": 20}


def test_header_cells_are_counted_across_chunks():
    import io

    from seika.sources import csv_files as C

    for text, n in ((b"a,b,c\nd\n", 3), (b"\n\r\n a,\n", 2), (b'"a\nb",c', 2), (b"", 1), (b"x" * 70000 + b"," * 9, 10), (b"a,b\r\nc", 2)):
        for size in (1, 7, 1 << 16):
            f = io.BytesIO(text)
            assert C._header_cells(lambda _, f=f, size=size: f.read(size)) == n, (text[:20], size)


def test_an_unresolved_key_is_an_error(spark):
    import pytest

    fact = spark.createDataFrame([("1", "10", "7", "A", "", "", "")], "market_code string, item_code string, origin_code string, grade string, class string, product_name string, unit_weight string")
    dims = {k: spark.createDataFrame([(1, c)], f"id long, {k}_code string") for k, c in (("market", "1"), ("item", "10"), ("origin", "8"))}
    dims["grade"] = spark.createDataFrame([(5, "A", "", "", "")], "id long, grade string, class string, product_name string, unit_weight string")
    with pytest.raises(Exception, match="no origin for key 7"):
        I.resolve_surrogate_keys(fact, dims).collect()
    dims["origin"] = spark.createDataFrame([(3, "7")], "id long, origin_code string")
    assert I.resolve_surrogate_keys(fact, dims).select("market_id", "item_id", "origin_id", "grade_id").first() == (1, 1, 3, 5)
