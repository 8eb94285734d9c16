"""Counts kept beside stored rows, so that dashboards and audits do not read old runs again.

A version is counted once, when it is written: per run and dataset a line without a control (rows, deviating
entities) and a line per control (checked rows, deviating rows). The rows of a run in a dataset lie in one version, so a line is
final and sums of lines are sums over runs. Runs stored without counts are counted from their rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideledger.fixed_values import CONTROL_DATASET, TREND_RUNS
from rideledger.functions.predicates import CHECKED_IF, measurable_controls
from rideledger.operators.count import measure_controls
from rideledger.plans.dashboard import control_breakdown, dashboard_metrics, entity_counts, trend_of
from rideledger.registry import RUN
from rideledger.sources.datasets import MEASURES_SCHEMA, Store

RIDE_DATASETS = ["ritten_detail", "va_ritten_detail"]
MEASURED = [*RIDE_DATASETS, "routes_detail"]
COLUMNS = [field.split(" ")[0] for field in MEASURES_SCHEMA.split(", ")]


def _whole(dataset: str, rows: DataFrame) -> DataFrame:
    """Rows and deviating entities per run; rows without an id are no entities."""
    if dataset in MEASURED:
        counts = entity_counts({dataset: rows if "id" in rows.columns else rows.withColumn("id", F.lit(None).cast("bigint"))})
    else:
        counts = rows.groupBy(RUN).agg(F.count("*").alias("total_checked"), F.lit(0).cast("bigint").alias("total_deviations"))
    return counts.withColumns({"dataset": F.lit(dataset), "control_id": F.lit(None).cast("int")}).select(*COLUMNS)


def counted(dataset: str, rows: DataFrame) -> list[DataFrame]:
    """All counts of some rows of a dataset.

    Controls that check some rows only are counted also where the version has no result of theirs,
    and not where it lacks the columns that decide; all others can be told from the number of rows.
    """
    frames = [_whole(dataset, rows)]
    if dataset in MEASURED:
        partial = {control for control, needed in CHECKED_IF.items() if CONTROL_DATASET[control] == dataset and {*needed} <= {*rows.columns}}
        whole = {control for control in measurable_controls(rows.columns, dataset) if control not in CHECKED_IF}
        frames.append(measure_controls(rows, dataset, controls=sorted(partial | whole)).select(*COLUMNS))
    return frames


def keep_measures(store: Store, datasets: list[str], version: str) -> None:
    """Count what a version holds and store the counts, in one job."""
    frames = [frame for dataset in datasets if (rows := store.read_version(dataset, version)) is not None for frame in counted(dataset, rows)]
    if frames:
        store.write_measures(reduce(DataFrame.unionByName, frames), version)


def _with_uncounted(store: Store, datasets: list[str], kept: DataFrame, count: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """Kept lines, and those of the stored runs that have none. Only run ids reach the driver."""
    versions = store.current_versions()
    known = {(row[RUN], row.dataset) for row in kept.select(RUN, "dataset").distinct().collect()}
    frames = [kept]
    for dataset in datasets:
        open_runs = {run: held for run, held in versions.items() if (run, dataset) not in known}
        if store.run_folders(dataset, open_runs):
            frames.append(count(dataset, store.read_current(dataset, open_runs)))
    return reduce(DataFrame.unionByName, frames)


def stored_entity_counts(store: Store, datasets: list[str] = RIDE_DATASETS) -> DataFrame:
    """Rows and deviating entities per current run and dataset."""
    kept = store.current_measures().where(F.col("control_id").isNull() & F.col("dataset").isin(datasets))
    return _with_uncounted(store, datasets, kept, _whole).drop("control_id")


def stored_controls(store: Store, datasets: list[str] = MEASURED) -> dict[str, list[int]]:
    """Controls that can be counted on each stored dataset."""
    return {dataset: measurable_controls(store.columns(dataset), dataset) for dataset in datasets}


def stored_measures(store: Store, controls: dict[str, list[int]]) -> DataFrame:
    """Checked and deviating rows per current run, dataset and control, as counting all rows gives them."""
    datasets = list(controls)
    kept = store.current_measures().where(F.col("dataset").isin(datasets))
    wanted = F.map_from_arrays(
        F.array(*[F.lit(dataset) for dataset in datasets]),
        F.array(*[F.array(*[F.lit(control) for control in found]).cast("array<int>") for found in controls.values()]),
    )
    every = kept.where("control_id is null").select(
        RUN, "dataset", F.col("total_checked").alias("n_rows"), F.explode(wanted[F.col("dataset")]).alias("control_id")
    )
    # A version without a column of a control: each row is checked and none deviates, unless a condition decides.
    unseen = F.when(F.col("control_id").isin(list(CHECKED_IF)), 0).otherwise(F.col("n_rows"))
    lines = every.join(kept.where("control_id is not null"), [RUN, "dataset", "control_id"], "left").select(
        RUN, "dataset", "control_id", F.coalesce("total_checked", unseen).alias("total_checked"),
        F.coalesce("total_deviations", F.lit(0)).cast("bigint").alias("total_deviations"),
    )
    return _with_uncounted(store, datasets, lines, lambda dataset, rows: measure_controls(rows, dataset).select(*COLUMNS))


def stored_trend(store: Store, runs: DataFrame, length: int = TREND_RUNS) -> DataFrame:
    """``control_trend`` of the stored runs."""
    controls = stored_controls(store)
    return trend_of(runs, controls, stored_measures(store, controls), length)


def stored_breakdown(store: Store, runs: DataFrame, executed: DataFrame) -> DataFrame:
    """``control_breakdown`` of the stored runs."""
    return control_breakdown(runs, executed, stored_measures(store, stored_controls(store)))


def stored_metrics(store: Store, runs: DataFrame) -> DataFrame:
    """``dashboard_metrics`` of the stored runs."""
    return dashboard_metrics(runs, stored_entity_counts(store))


def current_counts(store: Store, datasets: list[str]) -> dict[str, int]:
    """Rows of each dataset over the current runs, one number per dataset."""
    kept = store.current_measures().where(F.col("control_id").isNull() & F.col("dataset").isin(datasets))
    sums = _with_uncounted(store, datasets, kept, _whole).groupBy("dataset").agg(F.sum("total_checked").alias("n_rows")).collect()
    return dict.fromkeys(datasets, 0) | {row.dataset: row.n_rows for row in sums}
