"""Callers' columns that pass through an operator, whatever their names and types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(df: DataFrame) -> DataFrame:
    """The columns under names that no operator uses, by their place."""
    return df.toDF(*[_name(place) for place in range(len(df.columns))])


def _name(place: int) -> str:
    return f"column {place}"


def held(df: DataFrame, name: str) -> Column:
    """A column of ``df`` in the frame that ``apart`` has made of it."""
    return F.col(f"`{_name(df.columns.index(name))}`")


def back(df: DataFrame, but: Sequence[str] = ()) -> list[Column]:
    """All columns of ``df`` from the frame that ``apart`` has made of it, under their own names; ``but`` are left out."""
    return [F.col(f"`{_name(place)}`").alias(name) for place, name in enumerate(df.columns) if name not in but]
