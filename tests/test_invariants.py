"""SURVEY §5 invariants on the registered queries (sf0.001) and a property
test of the number parsers against a plain-Python model of the Go rules."""

import math
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from seika.functions import parse as P
from seika.operators import prices as R
from seika.sources import testdata as TD

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables missing")


def test_file_stats_add_up(spark):
    fs = E.queries()["file_stats"](spark, SF)
    bad = fs.where(F.col("rows_total") != F.col("rows_ok") + F.col("rows_error")).count()
    assert bad == 0 and fs.count() > 0


def test_summary_counts_cover_trend_counts(spark):
    st = TD.star(spark, SF, with_row_no=False)
    tr = R.prices_trend(st, all_items=True, full_history=True)[0].select(
        "item_code", F.col("trade_date").alias("period"), F.col("rows_count").alias("t"))
    sm = R.prices_summary(st, group_by="day", all_items=True, full_history=True)[0].select(
        "item_code", "period", F.col("rows_count").alias("s"))
    j = tr.join(sm, ["item_code", "period"], "left")
    assert j.where(F.col("s").isNull() | (F.col("s") < F.col("t"))).count() == 0


def test_market_counts_sum_to_total(spark):
    st = TD.star(spark, SF, with_row_no=False)
    cm = R.compare_markets(st, "1998-08-23", all_items=True)[0]
    per_item = {r.item_code: r.n for r in cm.groupBy("item_code").agg(F.sum("rows_count").alias("n")).collect()}
    direct = {r.item_code: r.n for r in st.fact.where(F.col("trade_date") == "1998-08-23")
              .groupBy("item_code").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per_item == direct


# ---------------------------------------------------------------- number parsers vs a Go model

_INT = re.compile(r"^[+-]?[0-9]+$")
_FLOAT = re.compile(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
_WS = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "    　"


def go_nullable(v, as_int):
    s = v.strip(_WS)
    if s in ("", "-"):
        return None, True
    s = s.replace(",", "")
    if as_int and _INT.match(s) and -2 ** 63 <= int(s) < 2 ** 63:
        return int(s), True
    if not _FLOAT.match(s):
        return None, False
    f = float(s)
    if math.isinf(f):
        return None, False
    if not as_int:
        return f, True
    return (int(f), True) if abs(f) < 9.2e18 else (None, False)


texts = st.text(alphabet=list("0123456789+-.,eE x　\t"), max_size=10)


@settings(max_examples=60, deadline=None)
@given(st.lists(texts, min_size=1, max_size=40))
def test_number_parsers_follow_go_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    fv, fok = P.parse_nullable_float(F.col("v"))
    iv, iok = P.parse_nullable_int(F.col("v"))
    got = df.select("v", fv, fok, iv, iok).collect()
    for r in got:
        ef, efok = go_nullable(r[0], False)
        ei, eiok = go_nullable(r[0], True)
        assert r[2] == efok and (r[1] == ef or (ef is not None and r[1] is not None and math.isclose(r[1], ef))), r
        assert (r[3], r[4]) == (ei, eiok), r
