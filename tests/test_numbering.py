import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seika.operators.numbering import number_rows, running, with_rows_before


@pytest.mark.parametrize("ranges", [None, 16])
def test_number_rows_matches_row_number_with_hot_group(spark, ranges):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else f"g{rnd.randint(0, 20)}"      # one group holds 2/3 of the rows
        rows.append((g, rnd.randint(0, 10_000), i))
    df = spark.createDataFrame(rows, "g string, k int, i int")
    got = {(r.g, r.i): r.rn for r in number_rows(df, ["g"], ["k", "i"], out="rn", start=2, ranges=ranges).collect()}
    exp = {}
    by = {}
    for g, k, i in rows:
        by.setdefault(g, []).append((k, i))
    for g, lst in by.items():
        for n, (k, i) in enumerate(sorted(lst)):
            exp[(g, i)] = n + 2
    assert got == exp


@pytest.mark.parametrize("ranges", [None, 16])
def test_number_rows_without_group(spark, ranges):
    df = spark.createDataFrame([(c,) for c in "qwertyuiopasdfg"], "c string")
    got = [r.c for r in number_rows(df, [], ["c"], out="rn", ranges=ranges)
           .orderBy("rn").collect()]
    assert got == sorted("qwertyuiopasdfg")


@pytest.mark.parametrize("ranges", [None, 16])
def test_running_sum_matches_cumsum(spark, ranges):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(-3, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "t int, v int")
    got = {r.t: r.s for r in running(df, ["t"], {"s": "v"}, ranges=ranges).collect()}
    acc, exp = 0, {}
    for t, v in rows:
        acc += v
        exp[t] = acc
    assert got == exp


def test_empty_tables(spark):
    df = spark.createDataFrame([], "t int, v int")
    assert running(df, ["t"], {"s": "v"}, {"m": F.col("v")}, {"l": "s"}).count() == 0
    assert number_rows(df, [], ["t"]).count() == 0 and with_rows_before(df, ["t"], 2).count() == 0


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_running_maximum_and_minimum_with_nulls_and_ties(spark, ranges):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(-3, 3), rnd.choice([None, None, None, i % 17]), f"s{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "t int, v int, k int, s string")
    got = running(df, ["t"], {"x": "v"}, {"newest": F.when(F.col("k").isNotNull(), F.struct("k", "s"))}, {"low": "x"}, ranges=ranges)
    acc, low, best, exp = 0, None, None, {}
    for t, v, k, s in rows:
        acc += v
        low = acc if low is None else min(low, acc)
        best = best if k is None else max(best or (k, s), (k, s))
        exp[t] = (acc, low, best)
    assert {r.t: (r.x, r.low, r.newest and tuple(r.newest)) for r in got.collect()} == exp
    # rows with one key: consecutive numbers, each once
    ties = number_rows(spark.createDataFrame([("g", 1)] * 7 + [("h", None)], "g string, k int"), ["g"], ["k"], ranges=ranges)
    assert sorted((r.g, r.rn) for r in ties.collect()) == [("g", i) for i in range(1, 8)] + [("h", 1)]


@pytest.mark.parametrize("block_rows", [2, 3, 7, 1000])
def test_frames_that_look_back_match_a_global_window(spark, block_rows):
    df = spark.createDataFrame([(i * 3, i * i % 13) for i in range(100)], "t int, v int")

    def frames(d, w):
        return d.select("t", F.lag("v").over(w).alias("p"), F.sum("v").over(w.rowsBetween(-2, 0)).alias("s"), *[c for c in d.columns if c == "_own"])
    got = frames(with_rows_before(df, ["t"], 2, block_rows), Window.partitionBy("_block").orderBy("_no")).where("_own").drop("_own")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frames(df, Window.orderBy("t")).collect()))
