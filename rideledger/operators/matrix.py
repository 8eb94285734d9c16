"""Row-by-column matrices in long form, with zeros where a cell has no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(cells: DataFrame, by: Sequence[str], row: str, column: str, value: str, total: str) -> DataFrame:
    """One row per ``row`` and ``column`` value that occurs in the scope ``by``.

    ``cells`` holds one counted row per combination and is read once: the matrix rows are made of it,
    and the column values of a scope, a short list of categories, are collected from the matrix rows
    by a window. ``total`` is the sum of the matrix row.
    """
    rows = cells.groupBy(*by, row).agg(
        F.map_from_entries(F.collect_list(F.struct(column, value))).alias("_cells"),
        F.sum(value).alias(total),
    )
    scope = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    heads = F.array_distinct(F.flatten(F.collect_set(F.map_keys("_cells")).over(scope)))
    return (
        rows.withColumn("_columns", heads)
        .withColumn(column, F.explode("_columns"))
        .withColumn(value, F.coalesce(F.try_element_at("_cells", F.col(column)), F.lit(0)))
        .select(*by, row, column, value, total)
    )
