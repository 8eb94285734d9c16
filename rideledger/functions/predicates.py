"""Row conditions of the controls, built from the columns a dataset actually has."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.fixed_values import CONTROL_DATASET, PLACEHOLDER_PLATES, RESULT_COLUMN
from rideledger.functions.text import deviation_flag
from rideledger.registry import entity


#: Columns a row must have filled to be checked by a control; the other controls check every row.
CHECKED_IF = {8: ("geplande_instap_tijd_s", "geplande_uitstap_tijd_s"), 10: ("route_nummer",)}


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a typed NULL where the dataset lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _differs_from_zero(df: DataFrame, name: str) -> str:
    return f"coalesce(nanvl(try_cast({name} as double), 0), 0) <> 0" if name in df.columns else "false"


def nonzero(df: DataFrame, name: str) -> Column:
    """Result other than zero; NULL and absent results count as zero."""
    return F.expr(_differs_from_zero(df, name))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions, F.lit(False))


def result_or_text(df: DataFrame, control: int) -> Column:
    """Deviation of a generic control: a result other than zero, or a message."""
    text = f"tekst_{control}"
    told = f"{text} is not null" if text in df.columns else "false"
    return F.expr(f"({_differs_from_zero(df, f'resultaat_{control}')}) or {told}")


def result_controls(df: DataFrame) -> list[int]:
    """Ids of the controls that have a result column."""
    return sorted(int(found[1]) for name in df.columns if (found := re.match(RESULT_COLUMN, name)))


def flags_deviation(df: DataFrame, control: int) -> Column:
    """Whether the stored result of a control reads as a deviation."""
    name = f"resultaat_{control}"
    if dict(df.dtypes)[name] == "string":
        return deviation_flag(F.col(name))
    return nonzero(df, name)


def checked_and_deviating(df: DataFrame, control: int) -> tuple[Column, Column]:
    """Which rows a control has checked, and which of them deviate."""
    result = f"resultaat_{control}"
    if control in CHECKED_IF:
        filled = " and ".join(f"{name} is not null" for name in CHECKED_IF[control])
        return F.expr(filled), F.expr(f"{filled} and {_differs_from_zero(df, result)}")
    if control == 11:
        return F.lit(True), F.expr(f"coalesce(try_cast({result} as double), 0) > 1")
    if control in CONTROL_DATASET:
        return F.lit(True), nonzero(df, result)
    return F.lit(True), result_or_text(df, control)


def measurable_controls(names: list[str], dataset: str) -> list[int]:
    """Controls that can be counted on a dataset with these columns: its own, and generic ones it has columns for."""
    found = {int(hit[1]) for name in names if (hit := re.match(r"^(?:resultaat|tekst)_(\d+)$", name))}
    kind = "route" if dataset == "routes_detail" else "rit"
    generic = {control for control in found if control not in CONTROL_DATASET and entity(control) == kind}
    own = {control for control, home in CONTROL_DATASET.items() if home == dataset and control in found}
    return sorted(generic | own)


def has_plate() -> Column:
    return F.col("kenteken").isNotNull() & (F.trim("kenteken") != "")


def has_real_plate() -> Column:
    return F.col("kenteken").isNotNull() & ~F.trim("kenteken").isin(PLACEHOLDER_PLATES)
