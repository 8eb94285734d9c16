"""Reports that list rides or routes: controls 1, 5, 8 and the generic ones."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.fixed_values import GROUPED_COLUMNS
from rideledger.functions.numeric import minutes_between
from rideledger.functions.predicates import checked_and_deviating, nonzero, optional, result_or_text
from rideledger.functions.text import strip_location_code
from rideledger.operators.count import PER_RUN, summary
from rideledger.operators.detail import Detail
from rideledger.registry import RUN, entity, report_columns

OUTCOMES = ("resultaat", "tekst", "controlewaarde", "dempelwaarde")
LOCATIONS = ("locatie_van", "locatie_naar")


def stored_name(df: DataFrame, name: str) -> str | None:
    """Column under which a dataset holds a field; times of day are stored in seconds as ``<name>_s``."""
    return next((held for held in (name, f"{name}_s") if held in df.columns), None)


def listed(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The named fields that exist, locations without their code."""
    held = [stored_name(df, name) for name in names]
    return [
        strip_location_code(F.col(name)).alias(name) if name in LOCATIONS else F.col(name) for name in held if name
    ]


class Parts(NamedTuple):
    """A list of deviating rows, not yet filtered: so that several lists can be made in one pass over a dataset."""

    #: The dataset with what the list adds to it.
    rows: DataFrame
    condition: Column
    columns: list[Column]
    order: list[str]
    hidden: tuple[str, ...] = ()

    def detail(self) -> Detail:
        return Detail(self.rows.where(self.condition).select(RUN, *self.columns), self.order, self.hidden)


def _text_or_empty(df: DataFrame, name: str, shown: str) -> Column:
    return F.coalesce(optional(df, name).cast("string"), F.lit("")).alias(shown)


# Control 1: invoiced ride without an order.


def report_1_summary(rides: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    return summary(rides, nonzero(rides, "resultaat_1"), by=by)


def report_1_detail(rides: DataFrame) -> Detail:
    return report_1_parts(rides).detail()


def report_1_parts(rides: DataFrame) -> Parts:
    rows = rides.withColumn("match_uitleg", F.col("tekst_1")) if "tekst_1" in rides.columns else rides
    names = [
        "datum", "klant_nummer", "reiziger_naam", "locatie_van", "postcode_van", "bestelde_vertrektijd",
        "locatie_naar", "postcode_naar", "bestelde_aankomsttijd", "match_uitleg", "bedrag_ex_btw", "status_rit",
        "route_nummer", "perceel_vervoerder",
    ]
    return Parts(rows, nonzero(rides, "resultaat_1"), listed(rows, names), ["datum", "klant_nummer", "reiziger_naam"])


# Control 5: planning failed.


def report_5_summary(routes: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    return summary(routes, result_or_text(routes, 5), by=by)


def report_5_detail(routes: DataFrame) -> Detail:
    return report_5_parts(routes).detail()


def report_5_parts(routes: DataFrame) -> Parts:
    shown = [
        F.to_date("datum").alias("route_date"),
        _text_or_empty(routes, "route_nummer", "route_nummer"),
        _text_or_empty(routes, "route_naam", "route_naam"),
        _text_or_empty(routes, "postcode_eerste", "van"),
        _text_or_empty(routes, "postcode_via", "via"),
        _text_or_empty(routes, "postcode_laatste", "naar"),
        _text_or_empty(routes, "tekst_5", "foutmelding"),
        F.coalesce(optional(routes, "aantal_lopers", "bigint"), F.lit(0)).alias("lopers"),
        F.coalesce(optional(routes, "aantal_rollers", "bigint"), F.lit(0)).alias("rollers"),
    ]
    return Parts(routes, result_or_text(routes, 5), shown, ["route_date", "route_nummer"])


def report_5_route_rides(routes: DataFrame, rides: DataFrame) -> Detail:
    """Rides of every route listed by control 5."""
    failed = routes.where(result_or_text(routes, 5) & F.col("datum").isNotNull()).select(
        RUN, F.to_date("datum").alias("datum"), "route_nummer"
    )
    names = [
        "datum", "route_nummer", "bestelde_aankomsttijd", "bestelde_vertrektijd", "klant_nummer", "reiziger_naam",
        "locatie_van", "plaats_van", "locatie_naar", "plaats_naar", "geplande_instap_tijd", "geplande_uitstap_tijd",
        "afwezigheids_melding",
    ]
    found = rides.withColumn("datum", F.to_date("datum")).join(failed, [RUN, "datum", "route_nummer"], "left_semi")
    rows = found.select(
        RUN,
        *listed(found, names),
        F.coalesce("geplande_instap_tijd_s", "bestelde_vertrektijd_s").alias("start_s"),
    ).fillna("", ["route_nummer", "reiziger_naam", "plaats_van", "plaats_naar", "afwezigheids_melding"])
    return Detail(rows, ["start_s", "klant_nummer", "reiziger_naam"], hidden=("start_s",))


# Control 8: travel time exceeded.


def report_8_summary(rides: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    """Only rides with both planned times count; a run without any has zeros."""
    planned, deviating = checked_and_deviating(rides, 8)
    return summary(rides, deviating, checked=planned, by=by)


def report_8_detail(rides: DataFrame) -> Detail:
    """All deviating rides, also those without planned times."""
    return report_8_parts(rides).detail()


def report_8_parts(rides: DataFrame) -> Parts:
    rows = rides.withColumns(
        {
            "max_reistijd": F.col("dempelwaarde_8"),
            "geplande_reistijd": F.col("controlewaarde_8"),
            "overschrijding": F.col("controlewaarde_8") - F.col("dempelwaarde_8"),
            "real_reistijd": minutes_between(F.col("gerealiseerde_instap_tijd_s"), F.col("gerealiseerde_uitstap_tijd_s")),
        }
    )
    names = [
        "datum", "klant_nummer", "reiziger_naam", "locatie_van", "locatie_naar", "geplande_instap_tijd",
        "geplande_uitstap_tijd", "max_reistijd", "geplande_reistijd", "overschrijding", "gerealiseerde_instap_tijd",
        "gerealiseerde_uitstap_tijd", "real_reistijd",
    ]
    return Parts(rows, nonzero(rides, "resultaat_8"), listed(rows, names), ["-overschrijding", "datum", "klant_nummer"])


# Generic controls.


def generic_fields(control: int) -> list[str]:
    """Fields a generic report shows, with the outcome columns of that control filled in."""
    return [f"{name}_{control}" if name in OUTCOMES else name for name in report_columns(control)]


def generic_summary(df: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> DataFrame:
    return summary(df, result_or_text(df, control), by=by)


def generic_detail(df: DataFrame, control: int) -> Detail:
    """Deviating rows with the report columns that the dataset has."""
    return generic_parts(df, control).detail()


def generic_parts(df: DataFrame, control: int) -> Parts:
    fields = generic_fields(control)
    if entity(control) == "rit":
        shown = listed(df, fields)
    else:
        shown = [F.col(held) for name in fields if (held := stored_name(df, name))]
    shown_names = [held for name in fields if (held := stored_name(df, name))]
    day = next((name for name in ("datum", "rit_datum") if name in df.columns), shown_names[0])
    second = "vervoerder" if "vervoerder" in df.columns else shown_names[min(1, len(shown_names) - 1)]
    hidden = tuple(name for name in dict.fromkeys((day, second)) if name not in shown_names)
    return Parts(df, result_or_text(df, control), [*shown, *[F.col(name) for name in hidden]], [day, second], hidden)


def grouped_detail(df: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> Detail:
    """Controls 1004 to 1006: deviating rides per vehicle."""
    keys = [name for name in GROUPED_COLUMNS[control] if name != "aantal_ritten"]
    rows = df.where(result_or_text(df, control)).groupBy(*by, *keys).agg(F.count("*").alias("aantal_ritten"))
    order = ["-rit_datum", "kenteken"] if control == 1006 else ["-aantal_ritten", "kenteken"]
    return Detail(rows, order)


def grouped_count(df: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> DataFrame:
    """Number of lines in the grouped list."""
    return grouped_detail(df, control, by).rows.groupBy(*by).agg(F.count("*").alias("total_rows"))
