"""Control 10: routes that a replanned stop order makes faster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideledger.functions.numeric import elapsed_minutes, minutes_between
from rideledger.functions.predicates import checked_and_deviating, optional
from rideledger.functions.text import strip_location_code
from rideledger.operators.count import PER_RUN, summary
from rideledger.operators.detail import Detail, ordering
from rideledger.plans.rides import listed
from rideledger.registry import RUN

ROUTE = [RUN, "datum", "route_nummer"]


def report_10_summary(routes: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    numbered, deviating = checked_and_deviating(routes, 10)
    return summary(routes, deviating, checked=numbered, by=by)


def _improved(routes: DataFrame) -> DataFrame:
    return routes.where(checked_and_deviating(routes, 10)[1])


def _route_key() -> Column:
    day = F.coalesce(F.col("datum").cast("date").cast("string"), F.lit("None"))
    return F.concat_ws("__", day, "route_nummer")


def report_10_routes(routes: DataFrame) -> Detail:
    """Improved routes, largest gain first."""
    minutes = F.col("controlewaarde_10")
    day = F.coalesce(F.to_date("datum").cast("string"), F.lit("None"))
    shown = F.when(minutes.isNotNull(), F.concat(minutes.cast("string"), F.lit(" min")))
    rows = _improved(routes).select(
        RUN,
        _route_key().alias("route_key"),
        F.to_date("datum").alias("route_datum"),
        F.col("route_nummer").cast("string").alias("route_nummer"),
        minutes.cast("double").alias("improvement_minutes"),
        F.coalesce(minutes.cast("double"), F.lit(0.0)).alias("gain"),
        F.concat_ws(" - ", day, "route_nummer", shown).alias("label"),
    )
    return Detail(rows, ["-gain", "-route_datum", "route_nummer"], hidden=("gain",))


def report_10_default_route(routes: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    """The route a report opens with: the first one listed."""
    first = F.min(
        F.struct(
            (-F.coalesce(F.col("controlewaarde_10").cast("double"), F.lit(0.0))).alias("gain"),
            F.to_date("datum").isNull().alias("undated"),
            (-F.unix_date(F.to_date("datum"))).alias("day"),
            "route_nummer",
            _route_key().alias("route_key"),
        )
    )
    return _improved(routes).groupBy(*by).agg(first.alias("first")).select(*by, "first.route_key")


def _improved_rides(routes: DataFrame, rides: DataFrame) -> DataFrame:
    """Rides of the improved routes that have a date."""
    dated = _improved(routes).where(F.col("datum").isNotNull()).select(RUN, F.to_date("datum").alias("datum"), "route_nummer")
    return rides.withColumn("datum", F.to_date("datum")).join(dated, ROUTE, "left_semi")


def report_10_durations(routes: DataFrame, rides: DataFrame) -> DataFrame:
    """Actual and replanned duration and number of rides of every improved route."""
    return (
        _improved_rides(routes, rides)
        .groupBy(*ROUTE)
        .agg(
            F.count("*").alias("rides"),
            minutes_between(F.min("netto_instap_s"), F.max("netto_uitstap_s")).alias("actual_minutes"),
            minutes_between(F.min("netto_herplan_instap_s"), F.max("netto_herplan_uitstap_s")).alias("replanned_minutes"),
        )
    )


# Stops of a ride: plan, kind of stop, column that holds its time.
STOPS = [
    ("actual", "pickup", "netto_instap_s"),
    ("actual", "dropoff", "netto_uitstap_s"),
    ("replanned", "pickup", "netto_herplan_instap_s"),
    ("replanned", "dropoff", "netto_herplan_uitstap_s"),
]


def report_10_stops(routes: DataFrame, rides: DataFrame) -> DataFrame:
    """Stops of every improved route in driving order, as driven and as replanned.

    Rides fan out to bare stops first; places and labels are only worked out for the stops that remain.
    A window numbers the stops of a route: that is what one vehicle does on one day, at most a few
    hundred stops, and the number of routes grows with the rides.
    """
    per_ride = ", ".join(
        f"struct('{plan}' as plan, '{kind}' as event_type, cast({time} as int) as time_s)" for plan, kind, time in STOPS
    )

    def at_stop(name: str) -> Column:
        return F.when(F.col("event_type") == "pickup", F.col(f"{name}_van")).otherwise(F.col(f"{name}_naar"))

    label = F.concat(strip_location_code(at_stop("locatie")), F.lit(" - "), F.coalesce("reiziger_naam", F.lit("")))
    events = (
        _improved_rides(routes, rides)
        .select("*", F.expr(f"inline(array({per_ride}))"))
        .select(
            *ROUTE,
            F.col("id").alias("ride_id"),
            "plan",
            "event_type",
            "time_s",
            at_stop("latitude").cast("double").alias("latitude"),
            at_stop("longitude").cast("double").alias("longitude"),
            F.btrim(label, F.lit(" -")).alias("label"),
        )
        .where("time_s is not null and latitude is not null and longitude is not null")
    )
    order = ordering(["time_s", "ride_id", "event_type", "label", "latitude", "longitude"])
    return events.withColumn("index", F.row_number().over(Window.partitionBy(*ROUTE, "plan").orderBy(*order)))


def report_10_detail(routes: DataFrame, rides: DataFrame) -> Detail:
    """Rides of every improved route."""
    rows = _improved_rides(routes, rides).withColumn(
        "geplande_reistijd", elapsed_minutes(F.col("geplande_instap_tijd_s"), F.col("geplande_uitstap_tijd_s"))
    )
    names = [
        "datum", "klant_nummer", "reiziger_naam", "geplande_instap_tijd", "locatie_van", "postcode_van",
        "geplande_uitstap_tijd", "locatie_naar", "postcode_naar", "geplande_reistijd", "bestelde_aankomsttijd",
        "bestelde_vertrektijd", "netto_instap", "netto_uitstap", "netto_herplan_instap", "netto_herplan_uitstap",
        "vervoerder",
    ]
    return Detail(
        rows.select(RUN, _route_key().alias("route_key"), optional(rows, "id", "bigint").alias("id"), *listed(rows, names)),
        ["route_key", "id", "datum"],
        hidden=("id",),
    )
