"""Tables of the source system."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.fixed_values import DEFAULT_SCHEMA, SOURCE_TABLES
from rideledger.operators.normalise import of_runs, run_column, snake_case_columns, with_run_id

# Gives the rows of a source table by its name.
Reader = Callable[[str], DataFrame]


def table_name(table: str, overrides: Mapping[str, str] | None = None, schema: str | None = DEFAULT_SCHEMA) -> str:
    """Name of a source table: its override, else within the configured schema."""
    return (overrides or {}).get(table) or f"{schema or DEFAULT_SCHEMA}.{table}"


def jdbc_reader(
    spark: SparkSession,
    options: Mapping[str, str],
    overrides: Mapping[str, str] | None = None,
    schema: str | None = DEFAULT_SCHEMA,
) -> Reader:
    """Read source tables over JDBC; run filters reach the database.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` in the
    options to let executors read in parallel, on a row id so that one large run is split too.
    """
    return lambda table: spark.read.format("jdbc").options(**options).option(
        "dbtable", table_name(table, overrides, schema)
    ).load()


def parquet_reader(spark: SparkSession, folder: str) -> Reader:
    """Read source tables from Parquet files or folders ``<folder>/<table>.parquet``."""
    return lambda table: spark.read.parquet(f"{folder}/{table}.parquet")


def whole_table(read: Reader, dataset: str) -> DataFrame:
    return snake_case_columns(read(SOURCE_TABLES[dataset]))


def run_table(read: Reader, dataset: str, run_ids: list[int]) -> DataFrame:
    """Rows of the given runs, filtered where the table is stored."""
    rows = whole_table(read, dataset)
    raw = run_column(rows)
    if run_ids and dict(rows.dtypes)[raw] in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.where(F.col(raw).isin([int(run) for run in run_ids]))
    return of_runs(with_run_id(rows), run_ids)
