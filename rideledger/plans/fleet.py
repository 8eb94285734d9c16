"""Fleet reports: emission class, fuel and vehicle age (controls 11, 12, 13 and 1004 to 1006)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideledger.fixed_values import CLIENT_KM, MERGED_EMISSION
from rideledger.functions.numeric import exact_sum, number, share
from rideledger.functions.predicates import any_of, checked_and_deviating, has_plate, has_real_plate, nonzero, optional
from rideledger.operators.count import PER_RUN, summary
from rideledger.operators.detail import Detail
from rideledger.operators.matrix import zero_filled


def _total(name: str, by: Sequence[str]) -> Column:
    """Total over the scope; only used on rows already counted per category."""
    return F.sum(name).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))


# Control 11: emission classes.


def _emission_class() -> Column:
    raw = F.col("controlewaarde_11")
    merged = [F.when(raw == given, shown) for given, shown in MERGED_EMISSION.items()]
    return F.coalesce(*merged, raw)


def _classified(rides: DataFrame) -> DataFrame:
    """Rides with an emission class and a real plate."""
    return rides.where(F.col("controlewaarde_11").isNotNull() & has_real_plate()).withColumn(
        "emission_class", _emission_class()
    )


def _client_km(rides: DataFrame) -> Column:
    parts = [F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in CLIENT_KM if name in rides.columns]
    return reduce(lambda left, right: left + right, parts, F.lit(0.0))


def report_11_summary(rides: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    return summary(rides, checked_and_deviating(rides, 11)[1], digits=2, by=by)


def report_11_classes(rides: DataFrame, by: Sequence[str] = PER_RUN) -> Detail:
    """Vehicles, rides and client kilometres per emission class, with shares."""
    per_plate = (
        _classified(rides)
        .groupBy(*by, "emission_class", "kenteken")
        .agg(F.count("*").alias("rides"), exact_sum(_client_km(rides)).alias("km"))
    )
    rows = (
        per_plate.groupBy(*by, "emission_class")
        .agg(F.count("kenteken").alias("vehicles"), F.sum("rides").alias("rides"), exact_sum(F.col("km")).alias("km"))
        .withColumns({"all_rides": _total("rides", by), "all_km": _total("km", by)})
    )
    km_share = F.when(F.col("all_km") > 0, share(F.col("km"), F.col("all_km"), 2))
    shown = rows.select(
        *by,
        "emission_class",
        "vehicles",
        "rides",
        share(F.col("rides"), F.col("all_rides"), 2).alias("ride_percentage"),
        F.col("km").alias("client_km"),
        km_share.alias("client_km_percentage"),
    )
    return Detail(shown, ["-vehicles", "-rides", "emission_class"])


def report_11_totals(rides: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    """Classified rides, and whether kilometres are known."""
    km = exact_sum(_client_km(rides))
    return _classified(rides).groupBy(*by).agg(F.count("*").alias("classified_rides"), (km > 0).alias("has_km"))


def report_11_vehicles(rides: DataFrame, by: Sequence[str] = PER_RUN) -> Detail:
    """Days, routes and rides per vehicle and emission class.

    Detail rows are counted once per day and route; the distinct counts see only what is left.
    """
    counted = (
        _classified(rides)
        .groupBy(*by, "kenteken", "emission_class", F.to_date("datum").alias("day"), "route_nummer")
        .agg(F.count("*").alias("rides"))
    )
    rows = counted.groupBy(*by, "kenteken", "emission_class").agg(
        F.count_distinct("day").alias("inzetdagen"),
        F.count_distinct("route_nummer").alias("routes"),
        F.sum("rides").alias("rides"),
    )
    return Detail(rows, ["emission_class", "-rides", "kenteken"])


def report_11_vehicle_count(rides: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    lines = _classified(rides).select(*by, "kenteken", "emission_class").distinct()
    return lines.groupBy(*by).agg(F.count("*").alias("total_rows"))


# Control 12: fuel.


def _has_fuel() -> Column:
    return F.coalesce(F.trim(F.col("controlewaarde_12").cast("string")) != "", F.lit(False))


def report_12_summary(rides: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    """Rides with a known fuel take the place of deviations."""
    return summary(rides, _has_fuel(), digits=2, by=by)


def report_12_fuels(rides: DataFrame, by: Sequence[str] = PER_RUN) -> Detail:
    fuels = rides.where(_has_fuel()).select(*by, F.col("controlewaarde_12").alias("fuel_type")).distinct()
    return Detail(fuels, ["fuel_type"])


def _fuel_matrix(rides: DataFrame, period: Column, by: Sequence[str]) -> Detail:
    cells = (
        rides.where(_has_fuel())
        .groupBy(*by, period.alias("period"), F.col("controlewaarde_12").alias("fuel_type"))
        .agg(F.count("*").alias("rides"))
    )
    # A period without a date is no line of the matrix, but its fuels keep their column.
    filled = zero_filled(cells, by, "period", "fuel_type", "rides", "total").where(F.col("period").isNotNull())
    rows = filled.withColumn("percentage", share(F.col("rides"), F.col("total"), 2))
    return Detail(rows, ["period", "fuel_type"])


def report_12_daily(rides: DataFrame, by: Sequence[str] = PER_RUN) -> Detail:
    return _fuel_matrix(rides, F.to_date("datum"), by)


def report_12_monthly(rides: DataFrame, by: Sequence[str] = PER_RUN) -> Detail:
    return _fuel_matrix(rides, F.date_format("datum", "yyyy-MM"), by)


# Controls 1004 and 1005: on-demand fleet by emission level or fuel.


def _categorised(rides: DataFrame, control: int) -> DataFrame:
    return rides.where(F.col(f"controlewaarde_{control}").isNotNull()).withColumn(
        "category", F.col(f"controlewaarde_{control}")
    )


def fleet_summary(rides: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> DataFrame:
    return summary(rides, nonzero(rides, f"resultaat_{control}"), by=by)


def fleet_categories(rides: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> Detail:
    return Detail(_categorised(rides, control).select(*by, "category").distinct(), ["category"])


def fleet_weekly(rides: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> Detail:
    """Distinct vehicles per ISO week and category; weeks of different years share a line."""
    cells = (
        _categorised(rides, control)
        .groupBy(*by, F.weekofyear("rit_datum").alias("iso_week"), "category")
        .agg(F.count_distinct("kenteken").alias("vehicles"))
    )
    filled = zero_filled(cells, by, "iso_week", "category", "vehicles", "total")
    return Detail(filled.where(F.col("iso_week").isNotNull()), ["iso_week", "category"])


def fleet_trips(rides: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> Detail:
    rows = _categorised(rides, control).groupBy(*by, "category").agg(F.count("*").alias("trips"))
    shown = rows.withColumn("percentage", share(F.col("trips"), _total("trips", by), 2))
    return Detail(shown, ["-trips", "category"])


def fleet_distance(rides: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> Detail:
    rows = (
        _categorised(rides, control)
        .groupBy(*by, "category")
        .agg(exact_sum(F.coalesce("afstand_direct", F.lit(0.0))).alias("distance"))
    )
    shown = rows.select(
        *by,
        "category",
        "distance",
        share(F.col("distance"), _total("distance", by), 2).alias("percentage"),
    )
    return Detail(shown, ["-distance", "category"])


# Controls 13 and 1006: vehicle age.


def vehicles_by_age(rides: DataFrame, control: int, date_column: str = "datum", by: Sequence[str] = PER_RUN) -> DataFrame:
    """One row per vehicle that the age control looked at; every age report starts from it.

    Detail rows are only counted, per day and combination of texts, which hashes without sorting;
    the largest texts are taken over the few rows that are left. Counting per day also gives distinct
    days without a distinct aggregate.
    """
    names = [f"{kind}_{control}" for kind in ("controlewaarde", "dempelwaarde", "resultaat", "tekst")]
    looked_at = any_of([F.col(name).isNotNull() for name in names if name in rides.columns])
    counted = (
        rides.where(has_plate() & looked_at)
        .groupBy(
            *by, "kenteken", F.to_date(date_column).alias("day"), optional(rides, names[1]).alias("threshold"),
            optional(rides, names[0]).alias("value"), optional(rides, names[3]).alias("text"),
        )
        .agg(F.count("*").alias("rides"))
    )
    age = number(F.col("value"))
    per_day = counted.groupBy(*by, "kenteken", "day").agg(
        F.sum("rides").alias("rides"),
        F.max("threshold").alias("threshold"),
        F.max("value").alias("value"),
        F.max("text").alias("text"),
        exact_sum(age * F.col("rides")).alias("age_sum"),
        F.sum(F.when(age.isNotNull(), F.col("rides"))).alias("ages"),
    )
    return per_day.groupBy(*by, "kenteken").agg(
        F.count("day").alias("days"),
        F.sum("rides").alias("rides"),
        F.max("threshold").alias("threshold"),
        F.max("value").alias("value"),
        F.max("text").alias("text"),
        exact_sum(F.col("age_sum")).alias("age_sum"),
        F.coalesce(F.sum("ages"), F.lit(0)).alias("ages"),
    )


def age_summary(vehicles: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    """Rows, vehicles, share of vehicles with a value, and mean age over all rows."""
    ages = F.sum("ages").cast("double")
    valued = F.count("value")
    return vehicles.groupBy(*by).agg(
        F.sum("rides").alias("total_checked"),
        F.count("*").alias("vehicles"),
        share(valued, F.count("*"), 2).alias("coverage_percentage"),
        (exact_sum(F.col("age_sum")) / F.nullif(ages, F.lit(0.0))).alias("average_age"),
    )


def vehicle_types(routes: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    """Vehicle type per plate, from the routes it drove."""
    return routes.where(has_plate()).groupBy(*by, "kenteken").agg(F.max("voertuigtype").alias("type"))


def age_vehicles(vehicles: DataFrame, types: DataFrame | None = None, by: Sequence[str] = PER_RUN) -> Detail:
    """Days, passengers, threshold, value, type and fitting per vehicle."""
    typed = vehicles.withColumn("type", F.lit("")) if types is None else vehicles.join(types, [*by, "kenteken"], "left")
    rows = typed.select(
        *by,
        "kenteken",
        F.col("days").alias("inzetdagen"),
        F.col("rides").alias("vervoerde_passagiers"),
        F.col("threshold").alias("drempelwaarde"),
        F.col("value").alias("controlewaarde"),
        F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("text", F.lit("")).alias("inrichting"),
    )
    return Detail(rows, ["kenteken"])


def age_totals(vehicles: DataFrame, by: Sequence[str] = PER_RUN) -> DataFrame:
    return vehicles.groupBy(*by).agg(F.sum("days").alias("inzetdagen"), F.sum("rides").alias("passagiers"))


def age_histogram(vehicles: DataFrame, by: Sequence[str] = PER_RUN) -> Detail:
    """Vehicles per rounded mean age."""
    mean = F.col("age_sum") / F.nullif(F.col("ages"), F.lit(0)).cast("double")
    aged = vehicles.withColumn("age_years", F.round(mean).cast("int")).where(F.col("age_years").isNotNull())
    return Detail(aged.groupBy(*by, "age_years").agg(F.count("*").alias("vehicles")), ["age_years"])
