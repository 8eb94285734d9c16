"""Lookups on the control registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rideledger.fixed_values import (
    CONTROL_DATASET,
    CONTROLS,
    DEFAULT_ENTITY,
    DEFAULT_METRIC,
    DEFAULT_RIDE_COLUMNS,
    DEFAULT_ROUTE_COLUMNS,
    DEFAULT_TITLE,
    REPORT_COLUMNS,
)

RUN = "stuurtabel_id"


def definition(control: int) -> tuple[str, str, str]:
    """Title, entity and metric label of a control."""
    return CONTROLS.get(control, (DEFAULT_TITLE.format(control), DEFAULT_ENTITY, DEFAULT_METRIC))


def entity(control: int) -> str:
    return definition(control)[1]


def detail_dataset(control: int, transport: str = "RG") -> str:
    """Dataset that a control reads for a run of the given transport."""
    if control in CONTROL_DATASET:
        return CONTROL_DATASET[control]
    if entity(control) == "route":
        return "routes_detail"
    return "va_ritten_detail" if transport.upper() == "VA" else "ritten_detail"


def report_columns(control: int) -> dict[str, str]:
    """Report columns of a control, with their headers."""
    default = DEFAULT_ROUTE_COLUMNS if entity(control) == "route" else DEFAULT_RIDE_COLUMNS
    return REPORT_COLUMNS.get(control, default)


def control_dimension(spark: SparkSession) -> DataFrame:
    """The registry as a small DataFrame; its size is known to the planner."""
    rows = ", ".join(f"({control}, '{title}', '{kind}', '{metric}')" for control, (title, kind, metric) in CONTROLS.items())
    return spark.sql(f"select * from values {rows} as controls(control_id, title, entity, metric_label)")
