import datetime

import pytest
from pyspark.sql import functions as F

from rideledger.fixed_values import DEVIATION_WORDS
from rideledger.functions.numeric import number
from rideledger.functions.text import deviation_flag, minutes_label, sort_key, strip_location_code, truthy
from rideledger.operators.detail import format_cells
from rideledger.operators.unpivot import as_text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(position, value) for position, value in enumerate(values)], f"i int, v {kind}")
    return [row.r for row in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_deviation_flag(spark):
    cases = {
        None: False, "1": True, " OK ": False, "Niet ok": True, "0": False, "2.0": True, "ja": False,
        "Rit overschrijdt max": True, "0.0": False, "-1": True, "voldoet": False, "nan": False, "True": False,
    }
    assert column(spark, list(cases), deviation_flag) == list(cases.values())


def test_truthy(spark):
    cases = {"1": True, "true": True, "YES": True, " ja ": True, "y": True, "1.0": True, "nee": False, "0": False, None: False}
    assert column(spark, list(cases), truthy) == list(cases.values())


def test_strip_location_code(spark):
    given = ["12345  Utrecht", "\t12345 Ede ", "1234 Ede", None, "12345", "99999 12345 x"]
    assert column(spark, given, strip_location_code) == ["Utrecht", "Ede", "1234 Ede", "", "12345", "12345 x"]


@pytest.mark.parametrize("minutes, label", [(None, "n.v.t."), (0, "0 min"), (59, "59 min"), (65, "1u 05m"), (600, "10u 00m")])
def test_minutes_label(spark, minutes, label):
    assert column(spark, [minutes], minutes_label, "bigint") == [label]


def test_typed_sort_puts_blanks_first_and_reads_dutch_numbers(spark):
    def ordered(values, descending=False):
        df = spark.createDataFrame([(value,) for value in values], "v string").withColumn("k", sort_key(F.col("v")))
        return [row.v for row in df.orderBy(F.col("k").desc() if descending else F.col("k").asc()).collect()]

    assert ordered(["02-01-1998", "", "1997-12-31", "03-01-1997"]) == ["", "03-01-1997", "1997-12-31", "02-01-1998"]
    assert ordered(["9:05", "10:00", "08:59"]) == ["08:59", "9:05", "10:00"]
    assert ordered(["1.234,5", "9", "12,5%", "-3"], descending=True) == ["1.234,5", "12,5%", "9", "-3"]
    assert ordered(["b", "A", " "], descending=True) == ["b", "A", " "]


def test_format_cells(spark):
    row = (
        datetime.date(1998, 3, 4), datetime.date(1998, 3, 5), 3661, None, 7, 1.5, "1998-03-04T05:06:07", "1998-03-04",
        "08:15:30", datetime.datetime(1998, 3, 4, 5, 6),
    )
    schema = (
        "datum date, gemeld_op date, netto_instap_s int, netto_uitstap_s int, lopers bigint, km double, melding string, "
        "vrij string, wachttijd string, moment timestamp_ntz"
    )
    shown = format_cells(spark.createDataFrame([row], schema)).first()
    assert list(shown) == [
        "04-03-1998", "1998-03-05", "01:01", "", "7", "1.5", "04/03/1998 05:06", "04-03-1998", "08:15", "04/03/1998 05:06",
    ]


def test_numbers_become_text_without_exponent(spark):
    df = spark.createDataFrame([(1.0,), (1e7,), (0.5,), (None,), (0.0001,)], "v double")
    assert [row.t for row in df.select(as_text(df, "v").alias("t")).collect()] == ["1.0", "10000000.0", "0.5", None, "0.0001"]


def test_whole_numbers_need_no_patterns_to_be_deviations(spark):
    texts = ["0", "1", "-3", "-0", "+1", "007", "0.0", "1e3", " 2 ", "2\x01", "NaN", "99999999999999999999", "niet 0", "ok", "", None]
    rows = spark.createDataFrame([(text,) for text in texts], "v string")
    by_words = F.coalesce(F.lower("v").rlike(DEVIATION_WORDS), F.lit(False))
    by_number = F.coalesce(~F.isnan(number(F.col("v"))) & (number(F.col("v")) != 0), F.lit(False))
    got = rows.select("v", deviation_flag(F.col("v")).alias("flag"), (by_words | by_number).alias("plain")).collect()
    assert [(row.v, row.flag) for row in got] == [(row.v, row.plain) for row in got]
    condition = rows.select(deviation_flag(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert condition.index("try_cast(v") < condition.index("RLIKE")  # tried before any pattern
