import datetime as dt

import pytest
from pyspark.sql import functions as F

from seika.functions import dates as D
from seika.functions import http as H
from seika.functions import parse as P
from seika.functions import text as T
from seika.sources import portal as PO


def one_col(spark, values, fn, name="v"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return [r[0] for r in df.select(fn(F.col(name))).collect()]


def test_trim_and_normalize(spark):
    vals = ["　 ab c　", " x ", "plain", ""]
    assert one_col(spark, vals, T.trim_unicode) == ["ab c", "x", "plain", ""]
    assert one_col(spark, vals, T.normalize_code) == ["abc", "x", "plain", ""]


def test_clean_text(spark):
    assert one_col(spark, ["  a\n\tb\r\n  c　 "], T.clean_text) == ["a b c"]


def test_parse_required_int(spark):
    df = spark.createDataFrame([(x,) for x in ["12", "+5", " 7 ", "", "x", "1.0", "-3"]], "v string")
    v, ok = P.parse_required_int(F.col("v"))
    got = [(r[0], r[1]) for r in df.select(v, ok).collect()]
    assert got == [(12, True), (5, True), (7, True), (None, False), (None, False), (None, False), (-3, True)]


def test_parse_nullable_float(spark):
    df = spark.createDataFrame([(x,) for x in ["", "-", "1,234.5", "1d", "1e3", "NaN", "-0.5", "1e400", ".5"]],
                               "v string")
    v, ok = P.parse_nullable_float(F.col("v"))
    got = [(r[0], r[1]) for r in df.select(v, ok).collect()]
    assert got == [(None, True), (None, True), (1234.5, True), (None, False), (1000.0, True),
                   (None, False), (-0.5, True), (None, False), (0.5, True)]


def test_parse_nullable_int_truncates_toward_zero(spark):
    df = spark.createDataFrame([(x,) for x in ["12.9", "-0.4", "-7.9", "1,000", "3000000000", "abc", "-"]],
                               "v string")
    v, ok = P.parse_nullable_int(F.col("v"))
    got = [(r[0], r[1], r[2]) for r in df.select(v, ok, P.int32_overflow(v)).collect()]
    assert got == [(12, True, False), (0, True, False), (-7, True, False), (1000, True, False),
                   (3000000000, True, True), (None, False, False), (None, True, False)]


def test_parse_trade_date(spark):
    rows = [(2021, 2, 29), (2020, 2, 29), (999, 1, 1), (2021, 13, 1), (10000, 1, 1), (2021, 4, 31)]
    df = spark.createDataFrame(rows, "y int, m int, d int")
    got = [r[0] for r in df.select(P.parse_trade_date("y", "m", "d")).collect()]
    assert got == [None, dt.date(2020, 2, 29), None, None, None, None]


def test_round2_matches_go_math_round(spark):
    # math.Round(x*100)/100: 1.005*100 is 100.49999999999999 in binary -> 1.0
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.255,), (0.125,), (None,)], "x double")
    got = [r[0] for r in df.select(D.round2("x")).collect()]
    assert got == [1.0, 2.68, -1.25, 0.13, None]


def test_period_label_and_calendar_shift(spark):
    df = spark.createDataFrame([(dt.date(2023, 3, 31),), (dt.date(2024, 2, 29),), (dt.date(2024, 3, 31),)], "d date")
    r = df.select(D.period_label("d", "week"), D.period_label("d", "month"),
                  D.calendar_shift("d", months=-1), D.calendar_shift("d", years=-1)).collect()
    assert [tuple(x) for x in r] == [
        ("2023-03-27", "2023-03", dt.date(2023, 3, 3), dt.date(2022, 3, 31)),
        ("2024-02-26", "2024-02", dt.date(2024, 1, 29), dt.date(2023, 3, 1)),
        ("2024-03-25", "2024-03", dt.date(2024, 3, 2), dt.date(2023, 3, 31)),
    ]
    assert D.add_date(dt.date(2023, 3, 31), months=-1) == dt.date(2023, 3, 3)
    assert D.add_date(dt.date(2024, 2, 29), years=-1) == dt.date(2023, 3, 1)
    with pytest.raises(ValueError):
        D.period_label("d", "year")


def test_like_pattern():
    assert T.like_pattern("a\\b") == "%ab%"
    assert T.like_pattern("50\\%") == "%50\\%%"
    assert T.like_pattern("x_y") == "%x_y%"
    with pytest.raises(ValueError):
        T.like_pattern("bad\\")


def test_like_search(spark):
    df = spark.createDataFrame([("A1", "Apple"), ("B2", "Banana"), ("C_3", "Cherry")], "c string, n string")
    got = sorted(r[0] for r in df.where(T.like_search("c", "n", "an")).collect())
    assert got == ["B2"]
    got = sorted(r[0] for r in df.where(T.like_search("c", "n", "_3")).collect())
    assert got == ["C_3"]


def test_status_class_and_paths(spark):
    df = spark.createDataFrame([(s,) for s in [99, 100, 204, 302, 404, 500, 600]], "s int")
    assert [r[0] for r in df.select(H.status_class("s")).collect()] == [
        "other", "1xx", "2xx", "3xx", "4xx", "5xx", "other"]
    paths = ["/health", "/ready", "/v1/prices/daily?x=1", "/v1/prices/latest", "/v1/coverage",
             "/v1/items/3", "/ingestion/files", "/metricsX"]
    assert one_col(spark, paths, H.normalize_path) == [
        "/health", "/ready", "/v1/prices/daily", "/other", "/other", "/v1/items", "/ingestion/files", "/other"]


def test_file_names(spark):
    df = spark.createDataFrame([
        ('attachment; filename="a b.csv"', "x"),
        ("attachment; filename*=UTF-8''%E3%81%82.CSV", "x"),
        ("", "1_東京 市場_vegetable"),
        ('attachment; filename="report"', "y"),
    ], "disp string, fb string")
    got = [r[0] for r in df.select(PO.download_file_name("disp", "fb")).collect()]
    assert got == ["x_a_b.csv", "x_あ.csv", "1_東京_市場_vegetable_1_東京_市場_vegetable.csv", "y_report.csv"]
    assert one_col(spark, ["  ", 'a/b:c*d?"e<f>g|h i'], T.safe_file_name) == ["unknown", "a_b_c_d__e_f_g_h_i"]
