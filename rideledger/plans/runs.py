"""Run list and executed controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.fixed_values import NON_DEVIATION_CONTROLS
from rideledger.functions.predicates import optional
from rideledger.registry import RUN, control_dimension


def current_runs(manifest: DataFrame) -> DataFrame:
    """Runs a user can select; shown newest first."""
    return manifest.where(F.col("is_current")).select(
        RUN,
        optional(manifest, "omschrijving").alias("omschrijving"),
        optional(manifest, "soortvervoer").alias("soortvervoer"),
    )


def selected_run(runs: DataFrame, requested: int | None) -> DataFrame:
    """The requested run when it is current, otherwise the newest one."""
    wanted = F.coalesce(F.col(RUN) == F.lit(requested).cast("bigint"), F.lit(False))
    return runs.orderBy(wanted.desc(), F.col(RUN).desc_nulls_last()).limit(1)


def ride_dataset(transport: Column) -> Column:
    """Ride dataset of a run: on-demand runs have their own."""
    return F.when(F.upper(transport) == "VA", "va_ritten_detail").otherwise("ritten_detail")


def executed_controls(executed: DataFrame) -> DataFrame:
    """Distinct executed controls per run with their label."""
    controls = (
        executed.where(F.col("uitgevoerd"))
        .select(
            RUN,
            F.coalesce("controlecode", "controle_id").alias("control_id"),
            optional(executed, "omschrijving").alias("omschrijving"),
        )
        .distinct()
    )
    described = F.coalesce(F.col("omschrijving"), F.lit("")) != ""
    label = F.when(described, F.concat_ws(" - ", F.col("control_id").cast("string"), "omschrijving")).otherwise(
        F.col("control_id").cast("string")
    )
    return controls.where(F.col("control_id").isNotNull() | described).withColumn("label", label)


def deviation_controls(executed: DataFrame) -> DataFrame:
    """Executed controls that count deviations, with display name, entity and title."""
    controls = executed_controls(executed).where(
        F.col("control_id").isNotNull() & ~F.col("control_id").isin(NON_DEVIATION_CONTROLS)
    )
    registry = control_dimension(executed.sparkSession)
    title = F.coalesce("title", F.concat(F.lit("Controle "), F.col("control_id").cast("string")))
    named = F.coalesce(F.nullif("omschrijving", F.lit("")), title)
    return controls.join(registry, "control_id", "left").select(
        RUN,
        "control_id",
        named.alias("control_name"),
        F.coalesce("entity", F.lit("rit")).alias("entity"),
        title.alias("title"),
    )
