"""Rows that may have one of many keys, told apart before anything is shuffled.

The keys are marked in a bitmap of 2^23 bits, kept as one row for 64 of them and broadcast: at most
131,072 rows of two numbers, whatever the input. A row without a mark has none of the keys; where
the bitmap fills up, more rows have a mark than need one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 23


def marked(rows: DataFrame, keys: DataFrame, columns: Sequence[str], name: str = "_marked") -> DataFrame:
    """``rows`` with a column that is false where none of ``keys`` equals the row in the given columns."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))
    words = keys.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits")
    )
    placed = rows.withColumn("_bit", bit).withColumn("_word", F.expr("_bit div 64"))
    found = placed.join(F.broadcast(words), "_word", "left")
    return found.withColumn(name, F.expr("coalesce(bit_get(_bits, cast(_bit % 64 as int)) = 1, false)")).drop("_word", "_bit", "_bits")
