"""Ordered row lists and how to page through them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rideledger.fixed_values import PAGE_ROWS
from rideledger.functions.text import cell, sort_key
from rideledger.registry import RUN
from rideledger.sources.datasets import shared_folder


def ordering(names: list[str]) -> list[Column]:
    """Sort columns from names; a leading minus means descending. NULLs always come last."""
    return [
        F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_last() for name in names
    ]


@dataclass(frozen=True)
class Detail:
    """Rows of a report and the order in which it shows them.

    ``rows`` is the whole result, not sorted. The order is only paid for when a page
    or a sorted listing is asked for. ``hidden`` columns take part in the order alone.
    """

    rows: DataFrame
    order: list[str]
    hidden: tuple[str, ...] = ()

    def total_order(self) -> list[Column]:
        """The report order, made total by the remaining columns so that pages never overlap."""
        named = {name.lstrip("-") for name in self.order}
        return ordering([*self.order, *(name for name in self.rows.columns if name not in named)])

    def listing(self) -> DataFrame:
        return self.rows.drop(*self.hidden)

    def total(self, by: Sequence[str] = (RUN,)) -> DataFrame:
        """Number of rows that the pages of a run have together."""
        return self.rows.groupBy(*by).agg(F.count("*").alias("total_rows"))

    def sorted(self) -> DataFrame:
        return self.rows.orderBy(*self.total_order()).drop(*self.hidden)

    def page(self, limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
        return self.rows.orderBy(*self.total_order()).offset(offset).limit(limit).drop(*self.hidden)


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/numbered-{uuid.uuid4().hex}"


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, unkept: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 1 within ``by`` in a given order, however many rows one group has.

    The whole order is cut into ranges that are sorted each on its own and written once to the shared scratch folder,
    without the ``unkept`` columns, which only the order needs. A row's number is its place in its range and how many
    rows of its group earlier ranges hold, which a small table tells: one row for a group and range.
    """
    spark = rows.sparkSession
    folder = _new_folder(spark)
    keys = [*[F.col(column).asc() for column in by], *order]
    kinds = dict(rows.dtypes)
    kept = [column for column in rows.columns if column not in unkept]
    written = [column for column in kept if kinds[column] != "void"]  # files hold no columns without a type
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).select(*written, "_at")
    placed = _stored(placed, f"{folder}/rows").withColumn("_range", F.shiftrightunsigned("_at", 33))
    held = placed.groupBy("_range", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1)
    held = held.select(F.col("_range").alias("_of"), "_before", *[F.col(column).alias(f"_of_{column}") for column in by])
    # Written too, so that its size is known and the rows are not shuffled once more to meet it.
    held = _stored(held, f"{folder}/held")
    same = [F.col("_range") == F.col("_of"), *[F.col(column).eqNullSafe(F.col(f"_of_{column}")) for column in by]]
    shown = [column if column in written else F.lit(None).alias(column) for column in kept]
    return placed.join(held, same).select(*shown, (F.col("_at") + F.col("_before")).cast("bigint").alias(name))


def sorted_rows(
    df: DataFrame, keys: Sequence[tuple[str, bool]], position: str, within: Sequence[str] = (), name: str = "place"
) -> DataFrame:
    """Rows numbered from 1 in the order a reader sorts displayed columns in, within each table.

    ``keys`` are (column, whether ascending), the first the most important. Blanks come first in ascending
    and last in descending order; rows that are alike in all keys keep the order of ``position``.
    """
    named = {f"_key_{place}": sort_key(F.col(column)) for place, (column, _) in enumerate(keys)}
    order = [F.col(key).asc() if ascending else F.col(key).desc() for key, (_, ascending) in zip(named, keys, strict=True)]
    keyed = df.withColumns(named)
    if "void" not in dict(keyed.dtypes).values():  # ranges are chosen by reading the rows once more, and these keys are slow to make
        keyed = _stored(keyed, f"{_new_folder(df.sparkSession)}/keyed")
    return numbered(keyed, within, [*order, F.col(position).asc()], name, unkept=[*named])


def rank(kind: str, value: Column, descending: bool = False) -> Column:
    """A sort key of one type for dates, numbers and ascending texts; NULLs come last either way."""
    none = F.struct(value.isNull().alias("none"))
    if kind == "string":
        if descending:
            raise ValueError("texts have ascending keys only")
        number, text = F.lit(0.0), F.coalesce(value, F.lit(""))
    else:
        days = F.unix_date(value) if kind == "date" else F.unix_micros(value) if kind == "timestamp" else value
        number, text = F.coalesce(days.cast("double") * (-1 if descending else 1), F.lit(0.0)), F.lit("")
    return F.struct(none["none"].alias("none"), number.alias("number"), text.alias("text"))


def format_cells(df: DataFrame) -> DataFrame:
    """Every column as displayed text."""
    return df.select(*[cell(name, kind, F.col(name)).alias(name) for name, kind in df.dtypes])
