"""Counts of checked and deviating rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.functions.numeric import share
from rideledger.functions.predicates import checked_and_deviating, measurable_controls
from rideledger.registry import RUN

PER_RUN = (RUN,)


def only_run(df: DataFrame, run_id: int | None) -> DataFrame:
    """Rows of one run; every row when no run is given."""
    return df if run_id is None else df.where(F.col(RUN) == run_id)


def summary(
    df: DataFrame,
    deviating: Column,
    digits: int = 3,
    checked: Column | None = None,
    by: Sequence[str] = PER_RUN,
) -> DataFrame:
    """Checked rows, deviations and their percentage, per run or over everything (``by=()``)."""
    checked = F.lit(True) if checked is None else checked
    return (
        df.groupBy(*by)
        .agg(F.count_if(checked).alias("total_checked"), F.count_if(checked & deviating).alias("total_deviations"))
        .withColumn("deviation_percentage", share(F.col("total_deviations"), F.col("total_checked"), digits))
    )


def measure_controls(df: DataFrame, dataset: str, by: Sequence[str] = PER_RUN, controls: Sequence[int] | None = None) -> DataFrame:
    """Checked and deviating rows of every control of a dataset, from one pass over it.

    Without ``controls`` those the dataset has columns for. All controls are counted as one wide aggregate row per group; only that row is
    turned into one row per control.
    """
    controls = measurable_controls(df.columns, dataset) if controls is None else controls
    conditions = {control: checked_and_deviating(df, control) for control in controls}
    counts = [
        F.count_if(condition).alias(f"{kind}_{control}")
        for control, pair in conditions.items()
        for kind, condition in zip(("checked", "deviating"), pair)
    ]
    if not controls:
        nothing = f"'{dataset}' as dataset", "0 as control_id", "0L as total_checked", "0L as total_deviations"
        return df.selectExpr(*by, *nothing).where(F.lit(False))
    per_control = ", ".join(
        f"struct({control} as control_id, checked_{control} as total_checked, deviating_{control} as total_deviations)"
        for control in controls
    )
    wide = df.groupBy(*by).agg(*counts)
    return wide.selectExpr(*by, f"'{dataset}' as dataset", f"inline(array({per_control}))")
