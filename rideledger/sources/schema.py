"""The type each stored column has, whatever a source sends.

Result tables are read with ``SELECT *`` and their columns come and go, also with other types: a
result is a number in one sync and a text in the next. What reports calculate with has a declared
type; everything else is stored as text, in the one form a number is shown in. So versions written by
different syncs always fit together, and a reader needs only the names of the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.fixed_values import CLIENT_KM, DATE_COLUMNS, LONG_DATASETS, NUMBER_COLUMNS, TIME_COLUMNS
from rideledger.functions.text import as_text
from rideledger.operators.normalise import AMOUNTS
from rideledger.operators.unpivot import LONG_SCHEMA
from rideledger.registry import RUN

SHARED = {RUN: "bigint", "client_slug": "string", "synced_at": "timestamp", "timestamp": "timestamp", "uitgevoerd": "boolean", "version": "string"}
MEASURES = [*AMOUNTS, *CLIENT_KM, "afstand_direct", "latitude_van", "longitude_van", "latitude_naar", "longitude_naar"]
LONG_TYPES = dict(field.split(" ") for field in LONG_SCHEMA.split(", "))


def stored_type(dataset: str, name: str) -> str:
    """Type of a column of a stored dataset."""
    if dataset in LONG_DATASETS:
        return LONG_TYPES.get(name, "string")
    if name in SHARED:
        return SHARED[name]
    if name in MEASURES:
        return "double"
    if name in NUMBER_COLUMNS.get(dataset, []):
        return "bigint"
    if name in DATE_COLUMNS.get(dataset, []):
        return "date"
    return "int" if name.endswith("_s") and name.removesuffix("_s") in TIME_COLUMNS else "string"


def _as_stored(df: DataFrame, name: str, kind: str) -> Column:
    if dict(df.dtypes)[name] == kind:
        return F.col(name)
    return as_text(df, name) if kind == "string" else F.col(name).try_cast(kind)


def as_stored(dataset: str, df: DataFrame) -> DataFrame:
    """Rows with the stored types."""
    return df.select(*[_as_stored(df, name, stored_type(dataset, name)).alias(name) for name in df.columns])


def read_schema(dataset: str, names: list[str], **kinds: str) -> str:
    """Schema of a stored dataset with the given columns; ``kinds`` are types of partition columns."""
    held = {name: stored_type(dataset, name) for name in names} | kinds
    return ", ".join(f"`{name}` {kind}" for name, kind in held.items())
