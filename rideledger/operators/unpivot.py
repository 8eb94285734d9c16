"""Wide control columns to one row per entity and control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.functions.predicates import flags_deviation, optional, result_controls
from rideledger.functions.text import as_label, as_text

LONG_SCHEMA = (
    "client_slug string, stuurtabel_id bigint, entity_type string, entity_id bigint, datum date, vervoerder string, "
    "perceel string, controle_id int, resultaat string, tekst string, controlewaarde string, dempelwaarde string, "
    "synced_at timestamp, is_deviation boolean"
)


def first_present(df: DataFrame, names: list[str], kind: str) -> Column:
    """The first of the named columns that exists, else NULL."""
    return next((F.col(name) for name in names if name in df.columns), F.lit(None)).cast(kind)


def control_rows(df: DataFrame, entity_type: str, id_column: str = "id", date_column: str = "datum") -> DataFrame:
    """One row per entity and control that has a result or a message.

    A single pass: every ``resultaat_N`` with its companions becomes one element of an
    array that is expanded in place, without a shuffle. The array is made by a projection of its own, which is
    compiled; as part of the generator it would be interpreted. It is never empty, so the outer form adds no row, and
    unlike the other it has no filter on the array's size, which would make the array twice.
    """
    controls = result_controls(df)
    if not controls:
        return df.sparkSession.createDataFrame([], LONG_SCHEMA)
    elements = F.array(
        *[
            F.struct(
                F.lit(control).alias("controle_id"),
                *[as_text(df, f"{kind}_{control}").alias(kind) for kind in ("resultaat", "tekst", "controlewaarde", "dempelwaarde")],
                flags_deviation(df, control).alias("is_deviation"),
            )
            for control in controls
        ]
    )
    wide = df.select(
        optional(df, "client_slug").alias("client_slug"),
        optional(df, "stuurtabel_id", "bigint").cast("bigint").alias("stuurtabel_id"),
        F.lit(entity_type).alias("entity_type"),
        optional(df, id_column, "bigint").cast("bigint").alias("entity_id"),
        first_present(df, [date_column, "rit_datum", "datum"], "date").alias("datum"),
        optional(df, "vervoerder").alias("vervoerder"),
        next((as_label(df, name) for name in ("perceel", "perceel_id") if name in df.columns), F.lit(None).cast("string")).alias("perceel"),
        optional(df, "synced_at", "timestamp").alias("synced_at"),
        elements.alias("_controls"),
    )
    return wide.select(*wide.columns[:-1], F.inline_outer("_controls")).where("resultaat is not null or tekst is not null")
