"""Dashboard: key figures, breakdown per control, trend, drill-down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideledger.fixed_values import CONTROL_DATASET, NON_DEVIATION_CONTROLS, TREND_RUNS
from rideledger.functions.numeric import exact_sum, share
from rideledger.functions.predicates import any_of, flags_deviation, measurable_controls, nonzero, result_controls
from rideledger.operators.count import measure_controls, summary
from rideledger.operators.detail import Detail
from rideledger.plans.runs import deviation_controls, ride_dataset
from rideledger.registry import RUN

DIGITS = 2
COUNTS = ["total_checked", "total_deviations"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counts_or_zero() -> list[Column]:
    return [F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name) for name in COUNTS]


def _percentage() -> Column:
    return share(F.col("total_deviations"), F.col("total_checked"), DIGITS)


def entity_counts(details: dict[str, DataFrame]) -> DataFrame:
    """Per run: checked rows and distinct entities with a deviating result, from the wide rows.

    A row deviates when any of its results does, so there is no need to unpivot first.
    """
    frames = []
    for dataset, detail in details.items():
        controls = [control for control in result_controls(detail) if control not in NON_DEVIATION_CONTROLS]
        deviating = any_of([flags_deviation(detail, control) for control in controls])
        frames.append(
            detail.groupBy(RUN)
            .agg(
                F.count("*").alias("total_checked"),
                F.count_distinct(F.when(deviating, F.col("id"))).alias("total_deviations"),
            )
            .withColumn("dataset", F.lit(dataset))
        )
    return _union(frames)


def entity_counts_from_long(details: dict[str, DataFrame], longs: dict[str, DataFrame]) -> DataFrame:
    """The same counts, from stored control rows."""
    frames = []
    for dataset, detail in details.items():
        checked = detail.groupBy(RUN).agg(F.count("*").alias("total_checked"))
        kept = ~F.coalesce("controle_id", F.lit(-1)).isin(NON_DEVIATION_CONTROLS)
        deviating = (
            longs[dataset]
            .where(F.col("is_deviation") & kept)
            .groupBy(RUN)
            .agg(F.count_distinct("entity_id").alias("total_deviations"))
        )
        frames.append(checked.join(deviating, RUN, "left").withColumn("dataset", F.lit(dataset)))
    return _union(frames)


def dashboard_metrics(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Key figures of every selectable run."""
    return (
        runs.select(RUN, ride_dataset(F.col("soortvervoer")).alias("dataset"))
        .join(counts, [RUN, "dataset"], "left")
        .select(RUN, *_counts_or_zero())
        .withColumns({"deviation_percentage": _percentage(), "deviation_amount": F.lit(0.0)})
    )


def measure_all(details: dict[str, DataFrame]) -> DataFrame:
    """Checked and deviating rows per run, dataset and control: one pass per dataset."""
    return _union([measure_controls(detail, dataset) for dataset, detail in details.items()])


def _home(control: Column, entity: Column, transport: Column) -> Column:
    """Dataset that a control of a run is counted on."""
    fixed = F.when(F.lit(False), F.lit(""))
    for control_id, dataset in CONTROL_DATASET.items():
        fixed = fixed.when(control == control_id, dataset)
    return F.coalesce(fixed, F.when(entity == "route", "routes_detail"), ride_dataset(transport))


def control_breakdown(runs: DataFrame, executed: DataFrame, measures: DataFrame) -> DataFrame:
    """Per run and executed control: deviations, checked rows, percentage and name."""
    transport = runs.select(RUN, "soortvervoer")
    return (
        deviation_controls(executed)
        .join(transport, RUN, "left")
        .withColumn("dataset", _home(F.col("control_id"), F.col("entity"), F.col("soortvervoer")))
        .join(measures, [RUN, "dataset", "control_id"], "left")
        .select(RUN, "control_id", "control_name", *_counts_or_zero())
        .withColumn("deviation_percentage", _percentage())
    )


def trend_runs(runs: DataFrame, length: int = TREND_RUNS) -> DataFrame:
    """For every run: itself and the runs before it of the same transport, newest at position 0.

    A run without a known transport is compared with all runs. Works on the run list
    only, which has one row per invoice run.
    """
    transport = F.upper(F.coalesce("soortvervoer", F.lit("")))
    scoped = runs.withColumn("own", transport).withColumn(
        "scope", F.explode(F.array_distinct(F.array(transport, F.lit(""))))
    )
    newest_first = Window.partitionBy("scope").orderBy(F.col(RUN).desc_nulls_last())
    placed = scoped.withColumn("place", F.row_number().over(newest_first))
    chosen = (
        placed.where(F.col("own") == F.col("scope"))
        .select("scope", F.col(RUN).alias("selected_run"), F.col("soortvervoer").alias("selected_transport"), "place")
        .withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(max(length, 1) - 1))))
        .withColumn("place", F.col("place") + F.col("position"))
    )
    return chosen.join(placed.select("scope", "place", RUN, "omschrijving"), ["scope", "place"]).select(
        "selected_run", "selected_transport", "position", RUN, "omschrijving"
    )


def _filled(points: DataFrame, measures: DataFrame) -> DataFrame:
    """Trend points with their counts; runs without rows count as zero."""
    return (
        points.join(measures, [RUN, "dataset", "control_id"], "left")
        .select(
            "selected_run",
            "control_id",
            "position",
            RUN,
            F.coalesce(F.nullif("omschrijving", F.lit("")), F.col(RUN).cast("string")).alias("label"),
            *_counts_or_zero(),
        )
        .withColumn("deviation_percentage", _percentage())
    )


def control_trend(runs: DataFrame, details: dict[str, DataFrame], length: int = TREND_RUNS) -> DataFrame:
    """Checked and deviating rows over the last runs, for every selectable run and control.

    Show it by ``position`` descending: oldest run first.
    """
    controls = {dataset: measurable_controls(detail.columns, dataset) for dataset, detail in details.items()}
    return trend_of(runs, controls, measure_all(details), length)


def trend_of(runs: DataFrame, controls: dict[str, list[int]], measures: DataFrame, length: int = TREND_RUNS) -> DataFrame:
    """The trend from counts per run, dataset and control; ``controls`` are those of each dataset."""
    countable = F.array(
        *[
            F.struct(F.lit(dataset).alias("dataset"), F.lit(control).alias("control_id"))
            for dataset, found in controls.items()
            for control in found
        ]
    )
    shared = F.col("control_id").isin(list(CONTROL_DATASET)) | (F.col("dataset") == "routes_detail")
    own = F.col("dataset") == ride_dataset(F.col("selected_transport"))
    points = trend_runs(runs, length).select("*", F.inline(countable)).where(shared | own)
    return _filled(points, measures)


def control_1_trend(runs: DataFrame, rides: dict[str, DataFrame], length: int = TREND_RUNS) -> DataFrame:
    """Trend of control 1 on the ride dataset of the run, whatever its transport."""
    measures = _union(
        [
            summary(detail, nonzero(detail, "resultaat_1")).select(
                RUN, F.lit(dataset).alias("dataset"), F.lit(1).alias("control_id"), *COUNTS
            )
            for dataset, detail in rides.items()
        ]
    )
    points = trend_runs(runs, length).withColumns(
        {"dataset": ride_dataset(F.col("selected_transport")), "control_id": F.lit(1)}
    )
    return _filled(points, measures)


def trend_previous_point(trend: DataFrame) -> DataFrame:
    """Per selected run and control: the point of the run before, and the highest deviation count."""
    before = F.col("position") == 1
    return trend.groupBy("selected_run", "control_id").agg(
        F.max(F.when(before, F.col(RUN))).alias("previous_run"),
        F.max(F.when(before, F.col("total_deviations"))).alias("previous_deviations"),
        F.max(F.when(before, F.col("total_checked"))).alias("previous_checked"),
        F.max(F.when(before, F.col("deviation_percentage"))).alias("previous_percentage"),
        F.max("total_deviations").alias("max_deviations"),
    )


def drilldown_rows(longs: list[DataFrame]) -> Detail:
    """Deviating control rows of all rides, latest first."""
    rows = _union(longs).where(F.col("is_deviation"))
    columns = [RUN, "entity_id", "vervoerder", "perceel", "datum", "controle_id", "resultaat", "tekst"]
    return Detail(rows.select(*columns), ["-datum", "controle_id"])


def rows_per_control_code(rides: DataFrame) -> Detail:
    """Number of rides per control code, most first."""
    return Detail(rides.groupBy("controlecode").agg(F.count("*").alias("n_rows")), ["-n_rows", "controlecode"])


def deviations_per_carrier(long: DataFrame) -> DataFrame:
    """Distinct deviating entities per run and carrier; entities of different types can have the same id."""
    rows = long.where(F.col("is_deviation"))
    entity = F.when(F.col("entity_id").isNotNull(), F.struct("entity_type", "entity_id"))
    return rows.groupBy(RUN, "vervoerder").agg(F.count_distinct(entity).alias("entities"))


def deviation_amounts(rides: DataFrame) -> DataFrame:
    """Invoiced amount of the rides with a deviating result, per run."""
    controls = [control for control in result_controls(rides) if control not in NON_DEVIATION_CONTROLS]
    deviating = any_of([flags_deviation(rides, control) for control in controls])
    amount = F.coalesce(exact_sum(F.when(deviating, F.col("bedrag_ex_btw"))), F.lit(0.0))
    return rides.groupBy(RUN).agg(amount.alias("deviation_amount"))
