"""The registered queries: each operator over the whole test tables, for all runs at once.

Nothing is cut down: no run is picked, no rows are capped. Only the page queries have
a limit, because a page is what they are about.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.adapter import CONTROL_PLAN, KEY_FIGURE_ROWS, RG_COLUMNS, RIDES, ROUTE_KEYS, ROUTES, VA_RIDES, Star
from rideledger.fixed_values import REPORT_COLUMNS, SOURCE_TABLES
from rideledger.functions.text import deviation_flag, minutes_label, sort_key, strip_location_code
from rideledger.operators import normalise
from rideledger.operators.detail import Detail, format_cells, sorted_rows
from rideledger.operators.unpivot import control_rows
from rideledger.plans import measures as kept_counts
from rideledger.plans import costs, dashboard, export, fleet, rides, routes, runs, sync
from rideledger.registry import RUN, detail_dataset
from rideledger.sources.datasets import Store, shared_folder
from rideledger.sources.tables import run_table, whole_table

SYNCED_AT = datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)
CLIENT = "demo"
QUERIES: dict[str, Callable[[Star], DataFrame | Detail]] = {}


def query(name: str):
    def register(build: Callable[[Star], DataFrame | Detail]):
        QUERIES[name] = build
        return build

    return register


def add(name: str, build: Callable[[Star], DataFrame | Detail]) -> None:
    QUERIES[name] = build


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(Star(spark, folder))
            return result.listing() if isinstance(result, Detail) else result

        return run

    return {name: bind(build) for name, build in QUERIES.items()}


# Sums of doubles differ in their last digits from engine to engine; results are compared to so many decimals:
# more than a mean of cents over a few rides has, and for amounts more than the two they have.
DIGITS = 9
AMOUNT_DIGITS = 4


def rounded(result: DataFrame | Detail, name: str, digits: int = DIGITS) -> DataFrame:
    rows = result.listing() if isinstance(result, Detail) else result
    return rows.withColumn(name, F.round(name, digits))


# Input sets.

OUTCOME_KINDS = ("resultaat_", "tekst_")
MEASURED_RIDES = [
    "geplande_instap_tijd_s", "geplande_uitstap_tijd_s", *[name for name in RG_COLUMNS if name.startswith(OUTCOME_KINDS)],
]
MEASURED_VA = [name for name in VA_RIDES if name.startswith(OUTCOME_KINDS)]
MEASURED_ROUTES = [name for name in ROUTES if name.startswith(OUTCOME_KINDS)]
RIDE_RESULTS = [name for name in RG_COLUMNS if name.startswith("resultaat_")]
VA_RESULTS = [name for name in VA_RIDES if name.startswith("resultaat_")]


def _expressions(rides: Iterable[str] = (), va_rides: Iterable[str] = (), of_routes: Iterable[str] = ()) -> list[str]:
    """What the named columns of the detail datasets are made of."""
    grouped = [ride for name in of_routes if name in ROUTES for ride in ROUTES[name][0]]
    return [*[RIDES.get(name, "p_type") for name in [*rides, *grouped, *(ROUTE_KEYS if of_routes else ())]], *[VA_RIDES[name] for name in va_rides]]


def measuring(star: Star) -> Star:
    """The tables for queries that count the controls of all datasets."""
    return star.sharing(_expressions(MEASURED_RIDES, MEASURED_VA, MEASURED_ROUTES))


def measured(star: Star) -> dict[str, DataFrame]:
    return {
        "ritten_detail": star.ritten_detail(MEASURED_RIDES),
        "routes_detail": star.routes_detail([*ROUTE_KEYS, *MEASURED_ROUTES]),
        "va_ritten_detail": star.va_ritten_detail(MEASURED_VA),
    }


def details(star: Star) -> dict[str, DataFrame]:
    return {
        "ritten_detail": star.ritten_detail(),
        "routes_detail": star.routes_detail(),
        "va_ritten_detail": star.va_ritten_detail(),
        "kentallen_route": star.kentallen_route(),
    }


def current(star: Star) -> DataFrame:
    return runs.current_runs(star.manifest())


def current_ids(star: Star, transport: str | None = None) -> list[int]:
    """Ids of the current runs; one per invoice run, so a short list."""
    chosen = current(star) if transport is None else current(star).where(F.col("soortvervoer") == transport)
    return sorted(row[RUN] for row in chosen.select(RUN).collect())


def breakdown(star: Star) -> DataFrame:
    star = measuring(star)
    return dashboard.control_breakdown(current(star), star.executed_controls(), dashboard.measure_all(measured(star)))


def source_name(name: str) -> str:
    """A column name as the source system writes it: ``KlantNummer``, ``Resultaat_8``, ``N_Ritten``."""
    parts = [part.capitalize() for part in name.split("_")]
    return "_".join(parts) if parts[-1].isdigit() or len(parts[0]) == 1 else "".join(parts)


def pascal(df: DataFrame) -> DataFrame:
    return df.toDF(*[source_name(name) for name in df.columns])


def with_code(star: Star) -> DataFrame:
    """Rides with the control code that a source may store with them; these tables have none, so one is made."""
    return star.ritten_detail(["klant_nummer"]).withColumn("controlecode", F.expr("case when klant_nummer % 11 <> 0 then klant_nummer % 11 end"))


# Run list and controls.

add("current_run_list", current)
add("executed_controls", lambda star: runs.executed_controls(star.executed_controls()))
add("control_dimension", lambda star: runs.deviation_controls(star.executed_controls()))
add("controlcode_counts", lambda star: dashboard.rows_per_control_code(with_code(star)).listing())
add("controlcode_row_count", lambda star: with_code(star).agg(F.count("*").alias("n_rows")))


@query("selected_run")
def _selected_run(star: Star) -> DataFrame:
    listed = current(star)
    asked = [runs.selected_run(listed, wanted).withColumn("asked", F.lit(text)) for wanted, text in
             ((200106, "current"), (199501, "not current"), (None, "none"))]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


# Dashboard.


def drilldown_total(detail: Detail) -> DataFrame:
    return detail.total().orderBy(RUN)


def _ride_datasets(star: Star) -> dict[str, DataFrame]:
    return {
        "ritten_detail": star.ritten_detail(["id", *RIDE_RESULTS]),
        "va_ritten_detail": star.va_ritten_detail(["id", *VA_RESULTS]),
    }


def _long_columns(names: Iterable[str]) -> list[str]:
    shared = ("id", "vervoerder", "perceel", "datum", "rit_datum")
    return [name for name in names if name in shared or name.startswith((*OUTCOME_KINDS, "controlewaarde_", "dempelwaarde_"))]


def _longs(star: Star) -> dict[str, DataFrame]:
    return {
        "ritten_detail": control_rows(star.ritten_detail(_long_columns(RG_COLUMNS)), "rit"),
        "va_ritten_detail": control_rows(star.va_ritten_detail(_long_columns(VA_RIDES)), "va_rit"),
    }


def _metrics_long(star: Star) -> DataFrame:
    anyone = ["reiziger_naam", "locatie_naar", "vervoerder"]  # one of each table, so that a ride counts that all of them know
    star = star.sharing(_expressions([*anyone, *_long_columns(RG_COLUMNS)], _long_columns(VA_RIDES)))
    details = {"ritten_detail": star.ritten_detail(anyone), "va_ritten_detail": star.va_ritten_detail(["stuurtabel_id"])}
    return dashboard.dashboard_metrics(current(star), dashboard.entity_counts_from_long(details, _longs(star)))


def _trend(star: Star) -> DataFrame:
    star = measuring(star)
    return dashboard.control_trend(current(star), measured(star))


add("control_breakdown", breakdown)
add("dashboard_metrics", lambda star: dashboard.dashboard_metrics(current(star), dashboard.entity_counts(_ride_datasets(star))))
add("dashboard_metrics_long", _metrics_long)
add("control_deviation_count", lambda star: dashboard.measure_all(measured(measuring(star))).select(RUN, "dataset", "control_id", "total_deviations"))
add("control_checked_count", lambda star: dashboard.measure_all(measured(measuring(star))).select(RUN, "dataset", "control_id", "total_checked"))
add("control_trend", _trend)
add("trend_previous_point", lambda star: dashboard.trend_previous_point(_trend(star)))
add("control_1_trend", lambda star: dashboard.control_1_trend(
    current(star), {"ritten_detail": star.ritten_detail(["resultaat_1"]), "va_ritten_detail": star.va_ritten_detail(["id"])}))
add("drilldown_rows", lambda star: dashboard.drilldown_rows(list(_longs(star).values())))
add("drilldown_total", lambda star: drilldown_total(dashboard.drilldown_rows(list(_longs(star).values()))))
add("drilldown_page", lambda star: dashboard.drilldown_rows(list(_longs(star).values())).page(100, 100))


# Reports on rides and routes.


def _ride_report(names: str) -> Callable[[Star], DataFrame]:
    return lambda star: star.ritten_detail(names.split())


REPORT_1 = _ride_report(
    "datum klant_nummer reiziger_naam locatie_van postcode_van bestelde_vertrektijd_s locatie_naar postcode_naar "
    "bestelde_aankomsttijd_s resultaat_1 tekst_1 bedrag_ex_btw status_rit route_nummer perceel_vervoerder"
)
REPORT_5_RIDES = _ride_report(
    "datum route_nummer bestelde_aankomsttijd_s bestelde_vertrektijd_s klant_nummer reiziger_naam locatie_van "
    "plaats_van locatie_naar plaats_naar geplande_instap_tijd_s geplande_uitstap_tijd_s afwezigheids_melding"
)
REPORT_8 = _ride_report(
    "datum klant_nummer reiziger_naam locatie_van locatie_naar geplande_instap_tijd_s geplande_uitstap_tijd_s "
    "dempelwaarde_8 controlewaarde_8 resultaat_8 gerealiseerde_instap_tijd_s gerealiseerde_uitstap_tijd_s"
)
REPORT_10_RIDES = _ride_report(
    "id datum route_nummer klant_nummer reiziger_naam locatie_van locatie_naar postcode_van postcode_naar "
    "latitude_van longitude_van latitude_naar longitude_naar geplande_instap_tijd_s geplande_uitstap_tijd_s "
    "bestelde_aankomsttijd_s bestelde_vertrektijd_s netto_instap_s netto_uitstap_s netto_herplan_instap_s "
    "netto_herplan_uitstap_s vervoerder"
)


def _routes(names: str) -> Callable[[Star], DataFrame]:
    return lambda star: star.routes_detail([*ROUTE_KEYS, *names.split()])


ROUTES_5 = _routes("resultaat_5 tekst_5 route_naam postcode_eerste postcode_laatste aantal_lopers aantal_rollers")
ROUTES_10 = _routes("resultaat_10 controlewaarde_10")

add("report_1_summary", lambda star: rides.report_1_summary(star.ritten_detail(["resultaat_1"])))
add("report_1_detail", lambda star: rides.report_1_detail(REPORT_1(star)))
add("report_1_page", lambda star: rides.report_1_detail(REPORT_1(star)).page(100, 100))
add("report_5_summary", lambda star: rides.report_5_summary(ROUTES_5(star)))
add("report_5_detail", lambda star: rides.report_5_detail(ROUTES_5(star)))
add("report_5_route_rides", lambda star: rides.report_5_route_rides(_routes("resultaat_5 tekst_5")(star), REPORT_5_RIDES(star)))
add("report_8_summary", lambda star: rides.report_8_summary(REPORT_8(star)))
add("report_8_detail", lambda star: rides.report_8_detail(REPORT_8(star)))
add("report_8_page", lambda star: rides.report_8_detail(REPORT_8(star)).page(100, 0))
add("report_10_summary", lambda star: routes.report_10_summary(ROUTES_10(star)))
add("report_10_routes", lambda star: routes.report_10_routes(ROUTES_10(star)))
add("report_10_default_route", lambda star: routes.report_10_default_route(ROUTES_10(star)))
add("report_10_durations", lambda star: routes.report_10_durations(
    ROUTES_10(star), star.ritten_detail(["datum", "route_nummer", "netto_instap_s", "netto_uitstap_s", "netto_herplan_instap_s", "netto_herplan_uitstap_s"])))
add("report_10_stops", lambda star: routes.report_10_stops(ROUTES_10(star), REPORT_10_RIDES(star)))
add("report_10_detail", lambda star: routes.report_10_detail(ROUTES_10(star), REPORT_10_RIDES(star)))


# Generic reports: one summary and one list per control.

DATASET_COLUMNS = {"ritten_detail": RG_COLUMNS, "routes_detail": [*ROUTE_KEYS, *ROUTES], "va_ritten_detail": list(VA_RIDES)}


def generic_dataset(control: int) -> str:
    return detail_dataset(control, "VA" if control > 1000 else "RG")


def generic_rows(star: Star, control: int) -> DataFrame:
    dataset = generic_dataset(control)
    fields = [held for name in rides.generic_fields(control) for held in (name, f"{name}_s")]
    wanted = [*fields, f"resultaat_{control}", f"tekst_{control}", "datum", "rit_datum", "vervoerder"]
    return getattr(star, dataset)([name for name in DATASET_COLUMNS[dataset] if name in wanted])


GENERIC = {
    control: f"report_{control}_generic" if control in (5, 12) else f"report_{control}_detail" for control in REPORT_COLUMNS
}
for _control, _name in GENERIC.items():
    add(_name, lambda star, control=_control: rides.generic_detail(generic_rows(star, control), control))
    if _control not in (5, 12):
        add(f"report_{_control}_summary", lambda star, control=_control: rides.generic_summary(generic_rows(star, control), control))
add("report_12_generic_summary", lambda star: rides.generic_summary(generic_rows(star, 12), 12))

GROUPED = {
    1004: ["kenteken", "resultaat_1004", "controlewaarde_1004"],
    1005: ["kenteken", "resultaat_1005", "controlewaarde_1005"],
    1006: ["kenteken", "rit_datum", "resultaat_1006", "tekst_1006", "controlewaarde_1006", "dempelwaarde_1006"],
}
for _control, _names in GROUPED.items():
    add(f"report_{_control}_grouped", lambda star, c=_control, names=_names: rides.grouped_detail(star.va_ritten_detail(names), c))
    add(f"report_{_control}_grouped_count", lambda star, c=_control, names=_names: rides.grouped_count(star.va_ritten_detail(names), c))


# Fleet reports.

CLASSES = _ride_report("datum route_nummer kenteken controlewaarde_11 resultaat_11 km_tarief extrakm_rolstoel")
FUELS = _ride_report("datum controlewaarde_12")
AGES = _ride_report("datum kenteken controlewaarde_13")


def _types(star: Star) -> DataFrame:
    return fleet.vehicle_types(star.routes_detail([*ROUTE_KEYS, "kenteken", "voertuigtype"]))


add("report_11_summary", lambda star: fleet.report_11_summary(star.ritten_detail(["resultaat_11"])))
add("report_11_classes", lambda star: fleet.report_11_classes(CLASSES(star)))
add("report_11_classes_pooled", lambda star: fleet.report_11_classes(CLASSES(star), by=()))
add("report_11_totals", lambda star: fleet.report_11_totals(CLASSES(star)))
add("report_11_vehicles", lambda star: fleet.report_11_vehicles(CLASSES(star)))
add("report_11_vehicle_count", lambda star: fleet.report_11_vehicle_count(CLASSES(star)))
add("report_12_summary", lambda star: fleet.report_12_summary(FUELS(star)))
add("report_12_fuels", lambda star: fleet.report_12_fuels(FUELS(star)))
add("report_12_daily", lambda star: fleet.report_12_daily(FUELS(star)))
add("report_12_monthly", lambda star: fleet.report_12_monthly(FUELS(star)))
add("report_12_monthly_pooled", lambda star: fleet.report_12_monthly(FUELS(star), by=()))
add("report_13_summary", lambda star: fleet.age_summary(fleet.vehicles_by_age(AGES(star), 13)))
add("report_13_vehicles", lambda star: fleet.age_vehicles(fleet.vehicles_by_age(AGES(star), 13), _types(star)))
add("report_13_totals", lambda star: fleet.age_totals(fleet.vehicles_by_age(AGES(star), 13)))
add("report_13_age_histogram", lambda star: fleet.age_histogram(fleet.vehicles_by_age(AGES(star), 13)))


def _va_ages(star: Star) -> DataFrame:
    names = ["rit_datum", "kenteken", "resultaat_1006", "dempelwaarde_1006", "controlewaarde_1006", "tekst_1006"]
    return fleet.vehicles_by_age(star.va_ritten_detail(names), 1006, "rit_datum")


add("report_1006_summary", lambda star: fleet.age_summary(_va_ages(star)))
add("report_1006_vehicles", lambda star: fleet.age_vehicles(_va_ages(star)))
add("report_1006_totals", lambda star: fleet.age_totals(_va_ages(star)))
add("report_1006_age_histogram", lambda star: fleet.age_histogram(_va_ages(star)))

FLEET = {
    "summary": fleet.fleet_summary,
    "classes": fleet.fleet_categories,
    "weekly": fleet.fleet_weekly,
    "trips": fleet.fleet_trips,
    "distance": fleet.fleet_distance,
}


def _fleet_rows(star: Star, control: int) -> DataFrame:
    return star.va_ritten_detail(
        ["rit_datum", "kenteken", "afstand_direct", f"resultaat_{control}", f"controlewaarde_{control}"]
    )


for _control in (1004, 1005):
    for _part, _build in FLEET.items():
        add(f"report_{_control}_{_part}", lambda star, c=_control, build=_build: build(_fleet_rows(star, c), c))
    add(f"export_{_control}_stacked", lambda star, c=_control: export.stacked_matrix(_fleet_rows(star, c), c))
add("export_1004_weekly_wide", lambda star: export.weekly_matrix_wide(_fleet_rows(star, 1004), 1004))


# Costs.

add("report_20_summary", lambda star: rounded(costs.report_20_summary(star.kentallen_route()), "average_cost"))
add("report_20_daily_table", lambda star: rounded(costs.report_20_daily_table(star.kentallen_route()), "kosten_rit"))
add("report_20_daily_chart", lambda star: rounded(costs.report_20_daily_chart(star.kentallen_route()), "kosten_rit"))
add("report_20_monthly", lambda star: rounded(costs.report_20_monthly(star.kentallen_route()), "kosten_rit"))


# Exports.

# Every control with a sheet, as executed in all runs whose data it reads.
SHEETS = sorted({1, 5, 8, 10, 11, 13, 20, 1004, 1005, 1006, *REPORT_COLUMNS})


def _executed_everywhere(star: Star) -> DataFrame:
    return star.run_list().withColumn("control_id", F.explode(F.array(*map(F.lit, SHEETS))))


def _bundle(star: Star) -> DataFrame:
    star = star.sharing([*_expressions(RG_COLUMNS, VA_RIDES, ROUTES), *KEY_FIGURE_ROWS])
    return export.export_bundle(details(star), _executed_everywhere(star), SHEETS)


add("export_summary", lambda star: export.export_summary(breakdown(star)))
add("export_bundle_long", _bundle)
add("export_10_all_routes", lambda star: format_cells(routes.report_10_detail(ROUTES_10(star), REPORT_10_RIDES(star)).listing()))
add("export_12_monthly_wide", lambda star: export.fuel_matrix_wide(FUELS(star), "monthly"))
add("format_export_columns", lambda star: format_cells(REPORT_8(star)))
add("strip_location_code", lambda star: star.ritten_detail(["id", "locatie_van"]).select("id", strip_location_code(F.col("locatie_van")).alias("locatie")))


@query("minutes_labels")
def _minutes_labels(star: Star) -> DataFrame:
    listed = rides.report_8_detail(REPORT_8(star)).rows.groupBy("real_reistijd").agg(F.count("*").alias("rides"))
    return listed.withColumn("label", minutes_label(F.col("real_reistijd")))


SHOWN_TEXT = """case l_linenumber when 1 then concat(lpad(cast(l_partkey % 28 + 1 as string), 2, '0'), '-05-1997')
    when 2 then concat('1998-06-', lpad(cast(l_suppkey % 28 + 1 as string), 2, '0'))
    when 3 then concat(cast(l_partkey % 24 as string), ':3', cast(l_suppkey % 10 as string))
    when 4 then concat(cast(l_partkey % 90 as string), '.', lpad(cast(l_suppkey % 1000 as string), 3, '0'), ',5')
    when 5 then concat(cast(l_partkey % 100 as string), ',25%')
    when 6 then concat('Route ', cast(l_partkey % 50 as string)) else ' ' end"""


@query("typed_sort")
def _typed_sort(star: Star) -> DataFrame:
    shown = star.base([]).select("l_orderkey", F.expr(SHOWN_TEXT).alias("shown"))
    return shown.withColumn("key", sort_key(F.col("shown"))).select("l_orderkey", "shown", "key.kind", "key.number", "key.text")


SORTED_BY = [("shown", False), ("l_returnflag", True)]


@query("typed_sort_rows")
def _typed_sort_rows(star: Star) -> DataFrame:
    """A table sorted by two displayed columns; rows that are alike in both keep their order."""
    shown = star.base([]).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.expr(SHOWN_TEXT).alias("shown"))
    shown = shown.withColumn("position", F.expr("l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey"))
    placed = sorted_rows(shown, SORTED_BY, "position", within=["l_linenumber"])
    return placed.select("l_linenumber", "place", "shown", "l_returnflag", "position")


# Normalising.


def _reader(star: Star) -> Callable[[str], DataFrame]:
    """The source system: its tables with its column names."""
    control_plan = star.spark.sql(CONTROL_PLAN)
    tables = {
        "runs": lambda: pascal(star.manifest().select(RUN, "omschrijving", "soortvervoer")),
        "ritten_detail": lambda: pascal(star.ritten_detail()),
        "routes_detail": lambda: pascal(star.routes_detail()),
        "kentallen_route": lambda: pascal(star.kentallen_route()),
        "va_ritten_detail": lambda: pascal(star.va_ritten_detail()),
        "control_catalog": lambda: control_plan.selectExpr("controle_id as ControleId", "omschrijving as Omschrijving"),
        "controls_done": lambda: star.executed_controls().selectExpr(
            "stuurtabel_id as StuurtabelId", "controle_id as ControleId", "controlecode as ControleCode_done",
            "case when uitgevoerd then 'Ja' else 'nee' end as Done",
        ),
    }
    by_table = {SOURCE_TABLES[dataset]: build for dataset, build in tables.items()}
    return lambda table: by_table[table]()


SCANNED = ["id", "stuurtabel_id", "klant_nummer", "bedrag_ex_btw", "netto_instap_s"]

add("source_table_scan", lambda star: whole_table(_reader(star), "ritten_detail").select(*SCANNED))
add("run_filtered_scan", lambda star: run_table(_reader(star), "ritten_detail", current_ids(star)).select(*SCANNED))


@query("current_runs")
def _current_runs(star: Star) -> DataFrame:
    source = star.rides(["soortvervoer"]).selectExpr(
        "case when stuurtabel_id % 100 = 7 then 'onbekend' else cast(stuurtabel_id as string) end as StuurtabelId",
        "soortvervoer as SoortVervoer",
    )
    return normalise.current_runs(source.withColumnRenamed("SoortVervoer", "Soortvervoer"))


add("snake_case_columns", lambda star: normalise.snake_case_columns(star.table("orders").select(
    F.col("o_orderkey").alias("KlantNummer"), F.col("o_totalprice").alias("BedragExBTW"), F.col("o_orderpriority").alias("Resultaat_1"),
    F.col("o_orderstatus").alias("Resultaat1"), F.to_date("o_orderdate").alias(" Datum (rit) "))))


@query("with_sync_metadata")
def _with_sync_metadata(star: Star) -> DataFrame:
    source = star.ritten_detail(["id"]).selectExpr("id as RitId", "concat(' ', cast(stuurtabel_id as string)) as StuurtabelId")
    out = normalise.with_sync_metadata(source, CLIENT, SYNCED_AT)
    return out.withColumn("synced_at", F.date_format("synced_at", "yyyy-MM-dd HH:mm:ss"))


add("resolve_aliases", lambda star: normalise.resolve_aliases(
    star.base(["o_custkey"]).selectExpr("l_orderkey as rit_nr", "l_suppkey as perceelnummer", "l_partkey as perceel",
    "cast(l_shipdate as date) as datum", "l_extendedprice as bedrag", "l_linestatus as executed"),
    ["rit_id", "perceel", "ritdatum", "afwijkingsbedrag", "uitgevoerd", "vervoerder"]))


@query("coerce_types")
def _coerce_types(star: Star) -> DataFrame:
    texts = star.table("lineitem").selectExpr(
        "l_orderkey",
        "case when l_linenumber = 3 then 'geen' else cast(cast(l_shipdate as date) as string) end as datum",
        "case when l_linenumber = 2 then 'x1' when l_linenumber = 6 then concat(' ', cast(l_partkey as string)) else cast(l_partkey as string) end as id",
        "case when l_linenumber = 4 then '-' else cast(cast(l_extendedprice as decimal(18,2)) as string) end as bedrag_ex_btw",
        "case when l_linenumber = 5 then 'los' when l_linenumber = 1 then concat(cast(l_suppkey as string), '.5') else cast(l_suppkey as string) end as perceel",
        "case l_linenumber when 1 then '1' when 2 then 'true' when 3 then 'YES' when 4 then ' ja ' when 5 then 'nee' when 6 then '0' end as uitgevoerd",
    )
    return normalise.coerce_types(texts, ["datum"], ["id", "bedrag_ex_btw", "perceel"])


def _prepared(dataset: str, transport: str) -> Callable[[Star], DataFrame]:
    def build(star: Star) -> DataFrame:
        ids = current_ids(star, transport)
        out = normalise.prepare(dataset, run_table(_reader(star), dataset, ids), CLIENT, ids, SYNCED_AT)
        return out.drop("synced_at")

    return build


add("prepare_rides", _prepared("ritten_detail", "RG"))
add("prepare_routes", _prepared("routes_detail", "RG"))
add("prepare_key_figures", _prepared("kentallen_route", "RG"))
add("prepare_va_rides", _prepared("va_ritten_detail", "VA"))


def _joined_controls(star: Star, ids: list[int]) -> DataFrame:
    read = _reader(star)
    return normalise.join_executed_controls(run_table(read, "controls_done", ids), whole_table(read, "control_catalog"))


add("executed_controls_join", lambda star: _joined_controls(star, current_ids(star)))


@query("prepare_executed_controls")
def _prepare_executed_controls(star: Star) -> DataFrame:
    ids = current_ids(star)
    out = normalise.prepare_executed_controls(_joined_controls(star, ids), CLIENT, ids, SYNCED_AT)
    return out.select(RUN, "controle_id", "controlecode", "omschrijving", "uitgevoerd", "timestamp", "client_slug").drop("timestamp")


add("control_unpivot", lambda star: _longs(star)["ritten_detail"].drop("client_slug", "synced_at"))
add("control_unpivot_va", lambda star: _longs(star)["va_ritten_detail"].drop("client_slug", "synced_at"))
add("control_unpivot_routes", lambda star: control_rows(star.routes_detail(), "route").drop("client_slug", "synced_at"))

RESULT_TEXT = """case l_linenumber when 1 then ' OK ' when 2 then 'Niet ok' when 3 then cast(l_quantity as string)
    when 4 then concat(' ', cast(l_partkey % 3 as string), ' ') when 5 then concat('Rit overschrijdt ', l_returnflag)
    when 6 then 'ja' end"""


@query("deviation_flag")
def _deviation_flag(star: Star) -> DataFrame:
    texts = star.table("lineitem").select("l_orderkey", F.expr(RESULT_TEXT).alias("resultaat"))
    return texts.withColumn("is_deviation", deviation_flag(F.col("resultaat")))


add("infer_column_types", lambda star: normalise.promote_text_columns(star.table("lineitem").selectExpr(
    "cast(l_orderkey as string) as whole", "l_extendedprice as money",
    "cast(cast(l_extendedprice as decimal(18,2)) as string) as number",
    "case when l_linenumber = 7 then 'n.v.t.' else cast(l_partkey as string) end as mixed",
    "case when l_linenumber = 7 then null else cast(l_suppkey as string) end as gaps", "cast(null as string) as empty",
    "l_returnflag as words")))

# Sync.


def _local_runs(star: Star) -> DataFrame:
    return star.run_list().where(f"{RUN} <= 200106")


def _source_runs(star: Star) -> DataFrame:
    return star.run_list().where(f"{RUN} >= 199603")


add("run_diff", lambda star: sync.run_diff(_local_runs(star), _source_runs(star)))
add("split_runs_by_transport", lambda star: star.run_list().select(
    RUN, sync.transport_group(F.concat(F.lit(" "), F.lower("soortvervoer"))).alias("transport_group")))


@query("merge_current")
def _merge_current(star: Star) -> DataFrame:
    before = star.kentallen_route().where(f"{RUN} <= 200106").drop("n_ritten")
    after = star.kentallen_route().where(f"{RUN} > 200106").drop("kosten_rit")
    diff = sync.run_diff(_local_runs(star), _source_runs(star))
    retained = [row[RUN] for row in diff.where("status = 'retained'").collect()]
    return sync.merge_current(before, after, retained)


add("manifest_build", lambda star: sync.build_manifest(
    normalise.current_runs(_reader(star)(SOURCE_TABLES["runs"])), CLIENT, SYNCED_AT).withColumn(
    "sync_timestamp", F.date_format("sync_timestamp", "yyyy-MM-dd HH:mm:ss")))


def _new_store(star: Star) -> Store:
    """A store below the shared folder that nothing has been written to yet."""
    return Store(star.spark, f"{shared_folder(star.spark)}/rideledger-{uuid.uuid4().hex}", CLIENT)


def _stored_key_figures(star: Star) -> Store:
    """A store that holds the key figures of the current runs."""
    store = _new_store(star)
    listed = sync.build_manifest(current(star), CLIENT, SYNCED_AT)
    versions = F.create_map(F.lit("kentallen_route"), F.lit("1"))
    rows = star.kentallen_route().join(current(star).select(RUN), RUN, "left_semi")
    store.write_version("kentallen_route", rows, "1")
    store.publish(listed.withColumn("data_versions", versions), "1")
    return store


def _stored_client(star: Star) -> Store:
    """A store that holds the detail rows of the current runs with their counts."""
    store = _new_store(star)
    found = {dataset: rows for dataset, rows in details(star).items() if dataset in kept_counts.MEASURED}
    held = current_ids(star)  # a list, as a sync has it: a join by run would shuffle all rows to a task for each run
    for dataset, rows in found.items():
        store.write_version(dataset, normalise.of_runs(rows, held), "1")
    kept_counts.keep_measures(store, list(found), "1")
    versions = F.create_map(*[F.lit(text) for dataset in found for text in (dataset, "1")])
    store.publish(sync.build_manifest(current(star), CLIENT, SYNCED_AT).withColumn("data_versions", versions), "1")
    return store


add("control_trend_stored", lambda star: kept_counts.stored_trend(_stored_client(star), current(star)))
add("control_breakdown_stored", lambda star: kept_counts.stored_breakdown(
    _stored_client(star), current(star), star.executed_controls().join(current(star).select(RUN), RUN, "left_semi")))
add("dashboard_metrics_stored", lambda star: kept_counts.stored_metrics(_stored_client(star), current(star)))
add("current_dataset_write", lambda star: _stored_key_figures(star).read_current("kentallen_route").groupBy(RUN).agg(F.count("*").alias("n_rows")))
add("current_dataset_read", lambda star: _stored_key_figures(star).read_current("kentallen_route").select(RUN, "datum", "route_id", "kosten_rit", "n_ritten"))


@query("history_append")
def _history_append(star: Star) -> DataFrame:
    store = _new_store(star)
    undated = F.when(F.col(RUN) % 100 != 12, F.col(RUN))
    rows = star.kentallen_route().withColumn(RUN, undated)
    for _ in range(2):  # the second write of the same version replaces the first
        store.append_history("kentallen_route", rows, SYNCED_AT, "1")
    return store.read_history("kentallen_route").groupBy("year", "month", RUN).agg(F.count("*").alias("n_rows"))


def _synced(star: Star) -> tuple[Store, list[DataFrame]]:
    """Two syncs of one client: first the runs up to 200106, then those from 199603 on."""
    store = _new_store(star)
    read = _reader(star)
    audits = []
    for condition, day in (("StuurtabelId <= 200106", 1), ("StuurtabelId >= 199603", 2)):
        snapshot = lambda table, kept=condition: (
            read(table).where(kept) if table == SOURCE_TABLES["runs"] else read(table)
        )
        audits.append(sync.sync_client(store, snapshot, SYNCED_AT.replace(day=day)))
    return store, audits


@query("sync_snapshot")
def _sync_snapshot(star: Star) -> DataFrame:
    store, _ = _synced(star)
    counted = []
    for dataset in sync.DATASETS:
        for area, rows in (("current", store.read_current(dataset)), ("history", store.read_history(dataset))):
            if rows is not None:
                per_run = rows.groupBy(F.col(RUN).cast("bigint").alias(RUN)).agg(F.count("*").alias("n_rows"))
                counted.append(per_run.select(F.lit(dataset).alias("dataset"), F.lit(area).alias("area"), RUN, "n_rows"))
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


@query("expire_to_history")
def _expire_to_history(star: Star) -> DataFrame:
    store, _ = _synced(star)
    return store.read_history("kentallen_route").select(F.col(RUN).cast("bigint").alias(RUN), "datum", "route_id", "kosten_rit", "n_ritten")


@query("sync_audit_counts")
def _sync_audit_counts(star: Star) -> DataFrame:
    _, audits = _synced(star)
    both = audits[0].unionByName(audits[1])
    return both.select(F.dayofmonth("started_at").alias("day"), F.explode("current_counts").alias("dataset", "n_current"), "history_counts").select(
        "day", "dataset", "n_current", F.coalesce(F.try_element_at("history_counts", F.col("dataset")), F.lit(0)).alias("n_history"))


add("latest_sync", lambda star: sync.latest_sync(star.table("orders").selectExpr(
    "o_orderpriority as client_slug", "o_orderkey as started_at", "o_orderstatus as status", "o_custkey as records_synced")))


@query("kentallen_backfill")
def _kentallen_backfill(star: Star) -> DataFrame:
    store = _new_store(star)
    listed = sync.build_manifest(current(star), CLIENT, SYNCED_AT)
    store.publish(listed.withColumn("data_versions", F.expr("map('ritten_detail', '1')")), "1")
    sync.backfill_key_figures(store, _reader(star), SYNCED_AT)
    return store.read_current("kentallen_route").select(RUN, "datum", "route_id", "kosten_rit", "n_ritten")


# Specified for the platform, beyond its pages.


add("deviations_per_vervoerder", lambda star: dashboard.deviations_per_carrier(_longs(star)["ritten_detail"]))
add("deviations_per_vervoerder_rg_va", lambda star: dashboard.deviations_per_carrier(_longs(star)["ritten_detail"].unionByName(_longs(star)["va_ritten_detail"])))
add("deviation_amount", lambda star: rounded(dashboard.deviation_amounts(star.ritten_detail(["bedrag_ex_btw", *RIDE_RESULTS])), "deviation_amount", AMOUNT_DIGITS))


@query("history_dedupe")
def _history_dedupe(star: Star) -> DataFrame:
    rows = star.base(["o_custkey"]).selectExpr(
        "o_custkey as entity_id", "l_linenumber as controle_id", "l_returnflag as resultaat",
        "l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey as synced_at", "l_quantity % 3 as stuurtabel_id",
    )
    return sync.newest_rows(rows.groupBy(*rows.columns).count().drop("count"), [RUN, "entity_id", "controle_id"])
