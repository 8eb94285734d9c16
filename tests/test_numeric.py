import math
import random

import pytest
from pyspark.sql import functions as F

from rideledger.functions.numeric import exact_sum, elapsed_minutes, half_even, minutes_between, number, share, weighted_mean


def test_half_even_equals_python_round(spark):
    chance = random.Random(7)
    ratios = [100.0 * chance.randint(0, m) / m for m in (chance.randint(1, 5000) for _ in range(4000))]
    ties = [n / 8 for n in range(200)] + [0.125, 2.675, 1.005, 0.0005, 12.345, 99.995, 100.0, 0.0]
    rows = [(value,) for value in ratios + ties]
    df = spark.createDataFrame(rows, "p double")
    for digits in (2, 3):
        got = df.select("p", half_even(F.col("p"), digits).alias("r")).collect()
        assert [row.r for row in got] == [round(row.p, digits) for row in got]


@pytest.mark.parametrize("part, whole, digits, expected", [(1, 800, 2, 0.12), (0, 5, 2, 0.0), (5, 0, 3, 0.0), (2, 3, 3, 66.667)])
def test_share(spark, part, whole, digits, expected):
    row = spark.createDataFrame([(part, whole)], "n bigint, m bigint").select(share(F.col("n"), F.col("m"), digits).alias("p")).first()
    assert row.p == expected


@pytest.mark.parametrize(
    "start, end, crossed, elapsed",
    [(28859, 28860, 1, 0), (85800, 600, -1420, -1420), (0, 59, 0, 0), (90, 30, -1, -1), (None, 30, None, None)],
)
def test_minutes(spark, start, end, crossed, elapsed):
    df = spark.createDataFrame([(start, end)], "a int, b int")
    row = df.select(minutes_between(F.col("a"), F.col("b")).alias("x"), elapsed_minutes(F.col("a"), F.col("b")).alias("y")).first()
    assert (row.x, row.y) == (crossed, elapsed)


@pytest.mark.parametrize(
    "values, total",
    [
        ([0.00004, 0.00002], 0.00006), ([1e15, 2e15, 0.25], 3e15 + 0.25), ([1e30, 1e30], 2e30), ([1e-20, 1.0], 1.0 + 1e-20),
        ([0.1] * 10, 1.0), ([None, 2.5], 2.5), ([None], None), ([math.inf, 1.0], math.inf), ([9e25] * 40, 9e25 * 40),
    ],
)
def test_sums_are_neither_cut_nor_fail(spark, values, total):
    row = spark.createDataFrame([(value,) for value in values], "v double").agg(exact_sum(F.col("v")).alias("s")).first()
    assert row.s == (None if total is None else pytest.approx(total, rel=1e-14))


def test_sums_do_not_depend_on_order(spark):
    values = [x / 100 for x in range(1, 3000, 7)]
    sums = {spark.createDataFrame([(v,) for v in order], "v double").repartition(n).agg(exact_sum(F.col("v")).alias("s")).first().s for n, order in ((1, values), (7, values[::-1]))}
    assert len(sums) == 1


def test_small_and_large_costs_are_weighed(spark):
    rows = [(0.00004, 2.0), (1e15, 0.0)]
    assert spark.createDataFrame(rows, "v double, w double").agg(weighted_mean(F.col("v"), F.col("w")).alias("m")).first().m == pytest.approx(0.00004)


def test_weighted_mean_without_weight_is_null(spark):
    df = spark.createDataFrame([(5.0, 0.0), (None, 3.0)], "v double, w double")
    assert df.agg(weighted_mean(F.col("v"), F.col("w")).alias("m")).first().m is None


def test_number_reads_only_numbers(spark):
    texts = ["1", " 2.5 ", "-1e3", "1.5d", "x", "", None, "inf", "nan", "1_000"]
    rows = spark.createDataFrame([(text,) for text in texts], "t string").select(number(F.col("t")).alias("n")).collect()
    assert [row.n for row in rows] == [1.0, 2.5, -1000.0, None, None, None, None, math.inf, None, None]
