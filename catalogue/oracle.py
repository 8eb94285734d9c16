"""SQL that states each registered result on its own, without the library.

Written from what a report has to show, statement by statement: one query per control
where the library counts all controls at once, distinct counts where it counts in
steps, and ``printf`` for exact rounding where it splits numbers.
"""

from __future__ import annotations

from catalogue.adapter import (
    CONTROL_PLAN,
    RG_COLUMNS,
    RIDES,
    ROUTE_GENERIC,
    ROUTE_KEYS,
    ROUTES,
    VA_RIDES,
    sql_views,
)
from catalogue.queries import AMOUNT_DIGITS, DIGITS, GENERIC, RESULT_TEXT, SHEETS, SHOWN_TEXT, generic_dataset
from rideledger.fixed_values import (
    CONTROL_DATASET,
    CONTROLS,
    DEVIATION_WORDS,
    REPORT_1_COLUMNS,
    REPORT_5_COLUMNS,
    REPORT_8_COLUMNS,
    REPORT_10_COLUMNS,
    REPORT_11_COLUMNS,
    REPORT_20_COLUMNS,
    REPORT_COLUMNS,
    STACKED_LABELS,
    VEHICLE_AGE_COLUMNS,
)

R = "stuurtabel_id"
PLATE = "kenteken IS NOT NULL AND TRIM(kenteken) <> ''"
REAL_PLATE = "kenteken IS NOT NULL AND TRIM(kenteken) NOT IN ('', '00-00-00', 'XX-XX-XX', '-  -  -')"
RUNS = "runs AS (SELECT stuurtabel_id, omschrijving, soortvervoer FROM manifest WHERE is_current)"


def pct(part: str, whole: str, digits: int) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN CAST(printf('%.{digits}f', 100.0::DOUBLE * CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE)) AS DOUBLE) "
        "ELSE 0.0::DOUBLE END"
    )


def nonzero(control: int) -> str:
    return f"COALESCE(resultaat_{control}, 0) <> 0"


def strip(column: str) -> str:
    return f"regexp_replace(regexp_replace(COALESCE({column}, ''), '^\\s+|\\s+$', '', 'g'), '^\\d{{5}}\\s+', '')"


def columns_of(dataset: str) -> list[str]:
    return {"ritten_detail": RG_COLUMNS, "routes_detail": [*ROUTE_KEYS, *ROUTES], "va_ritten_detail": list(VA_RIDES)}[dataset]


def deviates(control: int, dataset: str) -> str:
    held = columns_of(dataset)
    parts = []
    if f"resultaat_{control}" in held:
        parts.append(nonzero(control))
    if f"tekst_{control}" in held:
        parts.append(f"tekst_{control} IS NOT NULL")
    return "(" + " OR ".join(parts) + ")"


def summary(dataset: str, deviation: str, digits: int = 3, where: str = "TRUE") -> str:
    return f"""SELECT {R}, n AS total_checked, d AS total_deviations, {pct("d", "n", digits)} AS deviation_percentage
    FROM (SELECT {R}, COUNT(*) AS n, CAST(SUM(CASE WHEN {deviation} THEN 1 ELSE 0 END) AS BIGINT) AS d
          FROM {dataset} WHERE {where} GROUP BY 1)"""


def checked_summary(dataset: str, checked: str, deviation: str) -> str:
    """Summary of the checked rows; a run without any has zeros."""
    return f"""SELECT {R}, n AS total_checked, d AS total_deviations, {pct("d", "n", 3)} AS deviation_percentage
    FROM (SELECT {R}, COUNT(*) FILTER (WHERE {checked}) AS n, COUNT(*) FILTER (WHERE ({checked}) AND {deviation}) AS d FROM {dataset} GROUP BY 1)"""


def conditions(control: int, dataset: str) -> tuple[str, str]:
    """What a control checks and what deviates, in words of SQL."""
    if control == 8:
        both = "geplande_instap_tijd_s IS NOT NULL AND geplande_uitstap_tijd_s IS NOT NULL"
        return both, f"{both} AND {nonzero(8)}"
    if control == 10:
        return "route_nummer IS NOT NULL", f"route_nummer IS NOT NULL AND {nonzero(10)}"
    if control == 11:
        return "TRUE", "COALESCE(resultaat_11, 0) > 1"
    if control in CONTROL_DATASET:
        return "TRUE", nonzero(control)
    return "TRUE", deviates(control, dataset)


def countable(dataset: str) -> list[int]:
    entity = "route" if dataset == "routes_detail" else "rit"
    held = columns_of(dataset)
    controls = [*CONTROLS]
    return [
        control
        for control in controls
        if (f"resultaat_{control}" in held or f"tekst_{control}" in held)
        and (CONTROL_DATASET[control] == dataset if control in CONTROL_DATASET else CONTROLS[control][1] == entity)
    ]


def measures() -> str:
    parts = []
    for dataset in ("ritten_detail", "routes_detail", "va_ritten_detail"):
        for control in countable(dataset):
            checked, deviating = conditions(control, dataset)
            parts.append(
                f"SELECT {R}, '{dataset}' AS dataset, {control} AS control_id, "
                f"COUNT(*) FILTER (WHERE {checked}) AS total_checked, COUNT(*) FILTER (WHERE {deviating}) AS total_deviations "
                f"FROM {dataset} GROUP BY 1"
            )
    return "measures AS (" + " UNION ALL ".join(parts) + ")"


HOME = (
    "CASE WHEN control_id IN (1, 8, 11) THEN 'ritten_detail' WHEN control_id IN (1004, 1005) THEN 'va_ritten_detail' "
    "WHEN control_id IN (3, 5, 7, 10, 14, 15, 20, 21) THEN 'routes_detail' "
    "WHEN UPPER(soortvervoer) = 'VA' THEN 'va_ritten_detail' ELSE 'ritten_detail' END"
)
TITLES = "titles(control_id, title) AS (VALUES " + ", ".join(f"({c}, '{t}')" for c, (t, _, _) in CONTROLS.items()) + ")"
EXECUTED = f"""executed AS (
    SELECT DISTINCT {R}, COALESCE(controlecode, controle_id) AS control_id, omschrijving
    FROM executed_controls WHERE uitgevoerd)"""
BREAKDOWN = f"""{measures()}, {RUNS}, {TITLES}, {EXECUTED}, breakdown AS (
    SELECT e.{R}, e.control_id, COALESCE(e.omschrijving, t.title) AS control_name,
        COALESCE(m.total_checked, 0) AS total_checked, COALESCE(m.total_deviations, 0) AS total_deviations
    FROM executed e LEFT JOIN runs r USING ({R}) LEFT JOIN titles t USING (control_id)
    LEFT JOIN measures m ON m.{R} = e.{R} AND m.control_id = e.control_id AND m.dataset = ({HOME.replace("control_id", "e.control_id")})
    WHERE e.control_id <> 20)"""

POINTS = f"""{RUNS}, ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY soortvervoer ORDER BY {R} DESC) AS place FROM runs),
points AS (
    SELECT a.{R} AS selected_run, b.place - a.place AS position, b.{R}, b.soortvervoer,
        COALESCE(b.omschrijving, CAST(b.{R} AS VARCHAR)) AS label
    FROM ranked a JOIN ranked b ON a.soortvervoer = b.soortvervoer AND b.place >= a.place AND b.place < a.place + 6)"""
ASKED = "asked(dataset, control_id) AS (VALUES " + ", ".join(
    f"('{dataset}', {control})" for dataset in ("ritten_detail", "routes_detail", "va_ritten_detail") for control in countable(dataset)
) + ")"
TREND = f"""{measures()}, {POINTS}, {ASKED}, trend AS (
    SELECT p.selected_run, a.control_id, CAST(p.position AS INTEGER) AS position, p.{R}, p.label,
        COALESCE(m.total_checked, 0) AS total_checked, COALESCE(m.total_deviations, 0) AS total_deviations
    FROM points p JOIN asked a ON a.control_id IN (1, 8, 10, 11, 1004, 1005) OR a.dataset = 'routes_detail'
        OR a.dataset = CASE p.soortvervoer WHEN 'VA' THEN 'va_ritten_detail' ELSE 'ritten_detail' END
    LEFT JOIN measures m ON m.{R} = p.{R} AND m.dataset = a.dataset AND m.control_id = a.control_id)"""
COUNT_PCT = pct("total_deviations", "total_checked", 2)


def long_rows(dataset: str, kind: str) -> str:
    """Control rows of a dataset, one SELECT per control."""
    held = columns_of(dataset)
    day = "datum" if "datum" in held else "rit_datum"
    parts = []
    for control in sorted(int(name.split("_")[1]) for name in held if name.startswith("resultaat_")):
        texts = [
            f"CAST({name}_{control} AS VARCHAR) AS {name}" if f"{name}_{control}" in held else f"CAST(NULL AS VARCHAR) AS {name}"
            for name in ("resultaat", "tekst", "controlewaarde", "dempelwaarde")
        ]
        shared = "vervoerder, CAST(perceel AS VARCHAR) AS perceel" if "perceel" in held else "vervoerder, CAST(NULL AS VARCHAR) AS perceel"
        entity = "id" if "id" in held else "NULL"
        parts.append(
            f"SELECT CAST({R} AS BIGINT) AS {R}, '{kind}' AS entity_type, {entity} AS entity_id, {day} AS datum, {shared}, "
            f"{control} AS controle_id, {', '.join(texts)} FROM {dataset}"
        )
    return (
        f"(SELECT *, {flag('resultaat')} AS is_deviation FROM ({' UNION ALL '.join(parts)}) "
        "WHERE resultaat IS NOT NULL OR tekst IS NOT NULL)"
    )


def flag(column: str) -> str:
    return (
        f"(COALESCE(regexp_matches(LOWER({column}), '{DEVIATION_WORDS}'), FALSE) "
        f"OR COALESCE(TRY_CAST(TRIM({column}) AS DOUBLE) <> 0, FALSE))"
    )


LONG_RIDES = long_rows("ritten_detail", "rit")
LONG_VA = long_rows("va_ritten_detail", "va_rit")
DRILL = f"""SELECT {R}, entity_id, vervoerder, perceel, datum, controle_id, resultaat, tekst
    FROM (SELECT * FROM {LONG_RIDES} UNION ALL SELECT * FROM {LONG_VA}) WHERE is_deviation"""
METRICS = f"""{RUNS}, checked AS (
    SELECT {R}, 'RG' AS soort, COUNT(*) AS n FROM ritten_detail GROUP BY 1
    UNION ALL SELECT {R}, 'VA', COUNT(*) FROM va_ritten_detail GROUP BY 1),
deviating AS (
    SELECT {R}, 'RG' AS soort, COUNT(DISTINCT entity_id) AS d FROM {LONG_RIDES} WHERE is_deviation AND COALESCE(controle_id, -1) NOT IN (20) GROUP BY 1
    UNION ALL SELECT {R}, 'VA', COUNT(DISTINCT entity_id) FROM {LONG_VA} WHERE is_deviation AND COALESCE(controle_id, -1) NOT IN (20) GROUP BY 1),
joined AS (
    SELECT r.{R}, COALESCE(n, 0) AS n, COALESCE(d, 0) AS d FROM runs r
    LEFT JOIN checked c ON c.{R} = r.{R} AND c.soort = r.soortvervoer
    LEFT JOIN deviating v ON v.{R} = r.{R} AND v.soort = r.soortvervoer)
SELECT {R}, n AS total_checked, d AS total_deviations, {pct("d", "n", 2)} AS deviation_percentage,
    0.0::DOUBLE AS deviation_amount FROM joined"""

REPORT_1 = f"""SELECT {R}, datum, klant_nummer, reiziger_naam, {strip("locatie_van")} AS locatie_van, postcode_van, bestelde_vertrektijd_s,
    {strip("locatie_naar")} AS locatie_naar, postcode_naar, bestelde_aankomsttijd_s, tekst_1 AS match_uitleg, bedrag_ex_btw,
    status_rit, route_nummer, perceel_vervoerder
    FROM ritten_detail WHERE {nonzero(1)}"""
MINUTES = "CAST(FLOOR({1} / 60.0) - FLOOR({0} / 60.0) AS BIGINT)"
REPORT_8 = f"""SELECT {R}, datum, klant_nummer, reiziger_naam, {strip("locatie_van")} AS locatie_van, {strip("locatie_naar")} AS locatie_naar,
    geplande_instap_tijd_s, geplande_uitstap_tijd_s, dempelwaarde_8 AS max_reistijd, controlewaarde_8 AS geplande_reistijd,
    controlewaarde_8 - dempelwaarde_8 AS overschrijding, gerealiseerde_instap_tijd_s, gerealiseerde_uitstap_tijd_s,
    CASE WHEN gerealiseerde_instap_tijd_s IS NOT NULL AND gerealiseerde_uitstap_tijd_s IS NOT NULL
        THEN {MINUTES.format("gerealiseerde_instap_tijd_s", "gerealiseerde_uitstap_tijd_s")} END AS real_reistijd
    FROM ritten_detail WHERE {nonzero(8)}"""


def paged(select: str, order: str, names: list[str], limit: int, offset: int) -> str:
    ties = ", ".join(f"{name} ASC NULLS LAST" for name in names)
    return f"SELECT * FROM ({select}) ORDER BY {order}, {ties} LIMIT {limit} OFFSET {offset}"


REPORT_5 = f"""SELECT {R}, datum AS route_date, COALESCE(route_nummer, '') AS route_nummer, COALESCE(route_naam, '') AS route_naam,
    COALESCE(postcode_eerste, '') AS van, '' AS via, COALESCE(postcode_laatste, '') AS naar, COALESCE(tekst_5, '') AS foutmelding,
    COALESCE(aantal_lopers, 0) AS lopers, COALESCE(aantal_rollers, 0) AS rollers
    FROM routes_detail WHERE {deviates(5, "routes_detail")}"""
REPORT_5_RIDES = f"""SELECT {R}, datum, COALESCE(route_nummer, '') AS route_nummer, bestelde_aankomsttijd_s, bestelde_vertrektijd_s,
    klant_nummer, COALESCE(reiziger_naam, '') AS reiziger_naam, {strip("locatie_van")} AS locatie_van,
    COALESCE(plaats_van, '') AS plaats_van, {strip("locatie_naar")} AS locatie_naar, COALESCE(plaats_naar, '') AS plaats_naar,
    geplande_instap_tijd_s, geplande_uitstap_tijd_s, COALESCE(afwezigheids_melding, '') AS afwezigheids_melding
    FROM ritten_detail r WHERE EXISTS (
        SELECT 1 FROM routes_detail f WHERE f.{R} = r.{R} AND f.datum = r.datum AND f.route_nummer = r.route_nummer
        AND (COALESCE(f.resultaat_5, 0) <> 0 OR f.tekst_5 IS NOT NULL))"""

IMPROVED_RIDES = f"""improved AS (
    SELECT r.*, CAST(r.datum AS VARCHAR) || '__' || r.route_nummer AS route_key FROM ritten_detail r WHERE EXISTS (
        SELECT 1 FROM routes_detail f WHERE f.{R} = r.{R} AND f.datum = r.datum AND f.route_nummer = r.route_nummer
        AND COALESCE(f.resultaat_10, 0) <> 0))"""
ROUTE_LIST = f"""SELECT {R}, COALESCE(CAST(datum AS VARCHAR), 'None') || '__' || route_nummer AS route_key, datum AS route_datum, route_nummer,
    CAST(controlewaarde_10 AS DOUBLE) AS improvement_minutes,
    COALESCE(CAST(datum AS VARCHAR), 'None') || ' - ' || route_nummer
        || CASE WHEN controlewaarde_10 IS NOT NULL THEN ' - ' || CAST(controlewaarde_10 AS VARCHAR) || ' min' ELSE '' END AS label
    FROM routes_detail WHERE route_nummer IS NOT NULL AND {nonzero(10)}"""


def stop(kind: str, plan: str, side: str, time: str) -> str:
    label = f"TRIM({strip('locatie_' + side)} || ' - ' || COALESCE(reiziger_naam, ''), ' -')"
    return (
        f"SELECT {R}, datum, route_nummer, id AS ride_id, '{plan}' AS plan, '{kind}' AS event_type, {label} AS label, "
        f"latitude_{side} AS latitude, longitude_{side} AS longitude, {time} AS time_s FROM improved "
        f"WHERE latitude_{side} IS NOT NULL AND longitude_{side} IS NOT NULL AND {time} IS NOT NULL"
    )


STOPS = f"""{IMPROVED_RIDES}, stops AS (
    {stop("pickup", "actual", "van", "netto_instap_s")} UNION ALL {stop("dropoff", "actual", "naar", "netto_uitstap_s")}
    UNION ALL {stop("pickup", "replanned", "van", "netto_herplan_instap_s")}
    UNION ALL {stop("dropoff", "replanned", "naar", "netto_herplan_uitstap_s")})
SELECT *, ROW_NUMBER() OVER (PARTITION BY {R}, datum, route_nummer, plan
    ORDER BY time_s, ride_id, event_type, label, latitude, longitude) AS "index" FROM stops"""
TRUNC_MINUTES = "CAST(TRUNC((geplande_uitstap_tijd_s - geplande_instap_tijd_s) / 60.0) AS INTEGER)"
REPORT_10 = f"""{IMPROVED_RIDES} SELECT {R}, route_key, datum, klant_nummer, reiziger_naam, geplande_instap_tijd_s,
    {strip("locatie_van")} AS locatie_van, postcode_van, geplande_uitstap_tijd_s, {strip("locatie_naar")} AS locatie_naar, postcode_naar,
    {TRUNC_MINUTES} AS geplande_reistijd, bestelde_aankomsttijd_s, bestelde_vertrektijd_s, netto_instap_s, netto_uitstap_s,
    netto_herplan_instap_s, netto_herplan_uitstap_s, vervoerder FROM improved"""

CLASS = "CASE WHEN controlewaarde_11 IN ('Z', 'Z/Z') THEN 'Z' WHEN controlewaarde_11 IN ('6', '6/6') THEN '6' ELSE controlewaarde_11 END"
CLASSED = f"""classed AS (SELECT *, {CLASS} AS emission_class, COALESCE(km_tarief, 0) + COALESCE(extrakm_rolstoel, 0) AS km
    FROM ritten_detail WHERE controlewaarde_11 IS NOT NULL AND {REAL_PLATE})"""


def classes(by: str) -> str:
    over = f"PARTITION BY {by}" if by else ""
    comma = f"{by}, " if by else ""
    return f"""{CLASSED}, grouped AS (
    SELECT {comma}emission_class, COUNT(DISTINCT kenteken) AS vehicles, COUNT(*) AS rides, SUM(km) AS km FROM classed GROUP BY {comma}emission_class),
totals AS (SELECT *, SUM(rides) OVER ({over}) AS all_rides, SUM(km) OVER ({over}) AS all_km FROM grouped)
SELECT {comma}emission_class, vehicles, rides, {pct("rides", "all_rides", 2)} AS ride_percentage, km AS client_km,
    CASE WHEN all_km > 0 THEN {pct("km", "all_km", 2)} END AS client_km_percentage FROM totals"""


FUEL = "controlewaarde_12 IS NOT NULL AND TRIM(CAST(controlewaarde_12 AS VARCHAR)) <> ''"


def fuel_matrix(period: str, by: bool = True) -> str:
    run = f"{R}, " if by else ""
    same = f"d.{R} = {{0}}.{R} AND " if by else ""
    return f"""fuel AS (SELECT {run}{period} AS period, controlewaarde_12 AS fuel_type FROM ritten_detail WHERE {FUEL}),
days AS (SELECT {run}period, COUNT(*) AS total FROM fuel WHERE period IS NOT NULL GROUP BY ALL),
kinds AS (SELECT DISTINCT {run}fuel_type FROM fuel),
cells AS (SELECT {run}period, fuel_type, COUNT(*) AS rides FROM fuel GROUP BY ALL),
matrix AS (
    SELECT {"d." + R + ", " if by else ""}d.period, k.fuel_type, COALESCE(c.rides, 0) AS rides, d.total
    FROM days d JOIN kinds k ON {same.format("k")}TRUE
    LEFT JOIN cells c ON {same.format("c")}c.period = d.period AND c.fuel_type = k.fuel_type)"""


FUEL_SELECT = f"period, fuel_type, rides, CAST(total AS BIGINT) AS total, {pct('rides', 'total', 2)} AS percentage FROM matrix"


def ages(control: int, dataset: str, day: str) -> str:
    held = columns_of(dataset)
    names = [f"{kind}_{control}" for kind in ("controlewaarde", "dempelwaarde", "resultaat", "tekst") if f"{kind}_{control}" in held]
    any_value = " OR ".join(f"{name} IS NOT NULL" for name in names)
    return f"""aged AS (SELECT *, {day} AS day FROM {dataset} WHERE {PLATE} AND ({any_value}))"""


def age_summary(control: int) -> str:
    return f"""SELECT {R}, n AS total_checked, v AS vehicles, {pct("w", "v", 2)} AS coverage_percentage, average_age FROM (
    SELECT {R}, COUNT(*) AS n, COUNT(DISTINCT kenteken) AS v,
        COUNT(DISTINCT CASE WHEN controlewaarde_{control} IS NOT NULL THEN kenteken END) AS w,
        AVG(TRY_CAST(controlewaarde_{control} AS DOUBLE)) AS average_age
    FROM aged GROUP BY 1)"""


def age_vehicles(control: int, threshold: str, text: str) -> str:
    return f"""SELECT {R}, kenteken, COUNT(DISTINCT day) AS inzetdagen, COUNT(*) AS vervoerde_passagiers, {threshold} AS drempelwaarde,
    MAX(controlewaarde_{control}) AS controlewaarde, {text} AS inrichting FROM aged GROUP BY 1, 2"""


def age_totals() -> str:
    return f"""SELECT {R}, CAST(SUM(d) AS BIGINT) AS inzetdagen, CAST(SUM(n) AS BIGINT) AS passagiers FROM (
    SELECT {R}, kenteken, COUNT(DISTINCT day) AS d, COUNT(*) AS n FROM aged GROUP BY 1, 2) GROUP BY 1"""


def age_histogram(control: int, dataset: str) -> str:
    return f"""SELECT {R}, CAST(age AS INTEGER) AS age_years, COUNT(*) AS vehicles FROM (
    SELECT {R}, kenteken, ROUND(AVG(TRY_CAST(controlewaarde_{control} AS DOUBLE))) AS age FROM {dataset}
    WHERE {PLATE} AND controlewaarde_{control} IS NOT NULL GROUP BY 1, 2) WHERE age IS NOT NULL GROUP BY 1, 2"""


def fleet(control: int) -> str:
    return f"fleet AS (SELECT *, controlewaarde_{control} AS category FROM va_ritten_detail WHERE controlewaarde_{control} IS NOT NULL)"


def weekly(control: int) -> str:
    return f"""{fleet(control)},
weeks AS (SELECT DISTINCT {R}, EXTRACT('week' FROM rit_datum) AS w FROM fleet WHERE rit_datum IS NOT NULL),
kinds AS (SELECT DISTINCT {R}, category FROM fleet),
cells AS (SELECT {R}, EXTRACT('week' FROM rit_datum) AS w, category, COUNT(DISTINCT kenteken) AS vehicles FROM fleet GROUP BY ALL),
matrix AS (
    SELECT w.{R}, CAST(w.w AS INTEGER) AS iso_week, k.category, COALESCE(c.vehicles, 0) AS vehicles
    FROM weeks w JOIN kinds k ON k.{R} = w.{R} LEFT JOIN cells c ON c.{R} = w.{R} AND c.w = w.w AND c.category = k.category),
weekly AS (SELECT *, CAST(SUM(vehicles) OVER (PARTITION BY {R}, iso_week) AS BIGINT) AS total FROM matrix)"""


TRIPS = f"""trips AS (SELECT *, {pct("trips", "SUM(trips) OVER (PARTITION BY " + R + ")", 2)} AS percentage
    FROM (SELECT {R}, category, COUNT(*) AS trips FROM fleet GROUP BY 1, 2))"""
DISTANCE = f"""distances AS (SELECT *, {pct("distance", "SUM(distance) OVER (PARTITION BY " + R + ")", 2)} AS percentage
    FROM (SELECT {R}, category, SUM(COALESCE(afstand_direct, 0)) AS distance FROM fleet GROUP BY 1, 2))"""


def stacked(control: int) -> str:
    weeks, trips, km = STACKED_LABELS[control]
    return f"""{weekly(control)}, {TRIPS}, {DISTANCE}
SELECT {R}, '{weeks}' AS "type", CAST(iso_week AS VARCHAR) AS dimensie, category, vehicles AS cell, CAST(total AS DOUBLE) AS totaal, '' AS percentage FROM weekly
UNION ALL SELECT {R}, '{trips}', category, NULL, NULL, CAST(trips AS DOUBLE), CAST(percentage AS VARCHAR) || '%' FROM trips
UNION ALL SELECT {R}, '{km}', category, NULL, NULL, distance, CAST(percentage AS VARCHAR) || '%' FROM distances"""


COST = "TRY_CAST(kosten_rit AS DOUBLE)"
COUNTED = "COALESCE(TRY_CAST(n_ritten AS DOUBLE), 0)"
WEIGHT = f"SUM(CASE WHEN {COST} IS NOT NULL THEN {COUNTED} ELSE 0 END)"
MEAN_COST = f"CASE WHEN {WEIGHT} <> 0 THEN ROUND(SUM({COST} * {COUNTED}) / {WEIGHT}, {DIGITS}) END"
DAILY_COST = f"SELECT {R}, datum, CAST(SUM({COUNTED}) AS BIGINT) AS n_ritten, {MEAN_COST} AS kosten_rit FROM kentallen_route GROUP BY 1, 2"


# Cells as displayed.


def day(column: str) -> str:
    return f"COALESCE(strftime({column}, '%d-%m-%Y'), '')"


def clock(column: str) -> str:
    return f"COALESCE(printf('%02d:%02d', CAST(FLOOR({column} / 3600.0) AS INTEGER), CAST(FLOOR({column} / 60.0) AS INTEGER) % 60), '')"


def text(column: str) -> str:
    return f"COALESCE(CAST({column} AS VARCHAR), '')"


def money(column: str) -> str:
    """Amounts have at most ten decimals and are below ten million here."""
    return f"COALESCE(CAST({column} AS VARCHAR), '')"


REPORT_8_SOURCE = [
    "stuurtabel_id", "datum", "klant_nummer", "reiziger_naam", "locatie_van", "locatie_naar", "geplande_instap_tijd_s",
    "geplande_uitstap_tijd_s", "dempelwaarde_8", "controlewaarde_8", "resultaat_8", "gerealiseerde_instap_tijd_s",
    "gerealiseerde_uitstap_tijd_s",
]


def shown(name: str) -> str:
    if name in ("datum", "rit_datum", "route_date"):
        return day(name)
    return clock(name) if name.endswith("_s") else text(name)


SHEET_SQL = {
    1: (REPORT_1, "datum klant_nummer reiziger_naam locatie_van postcode_van bestelde_vertrektijd_s locatie_naar postcode_naar "
        "bestelde_aankomsttijd_s match_uitleg bedrag_ex_btw status_rit route_nummer perceel_vervoerder"),
    5: (REPORT_5, "route_date route_nummer route_naam van via naar foutmelding lopers rollers"),
    8: (REPORT_8, "datum klant_nummer reiziger_naam locatie_van locatie_naar geplande_instap_tijd_s geplande_uitstap_tijd_s max_reistijd "
        "geplande_reistijd overschrijding gerealiseerde_instap_tijd_s gerealiseerde_uitstap_tijd_s real_reistijd"),
    10: (f"WITH {REPORT_10}".replace("route_key, datum,", "route_key, id, datum,", 1), "route_key datum klant_nummer reiziger_naam geplande_instap_tijd_s locatie_van postcode_van geplande_uitstap_tijd_s "
         "locatie_naar postcode_naar geplande_reistijd bestelde_aankomsttijd_s bestelde_vertrektijd_s netto_instap_s netto_uitstap_s "
         "netto_herplan_instap_s netto_herplan_uitstap_s vervoerder"),
    11: (f"""WITH {CLASSED} SELECT {R}, kenteken, emission_class, COUNT(DISTINCT datum) AS inzetdagen,
         COUNT(DISTINCT route_nummer) AS routes, COUNT(*) AS rides FROM classed GROUP BY 1, 2, 3""",
         "kenteken emission_class inzetdagen routes rides"),
    13: (f"""WITH {ages(13, "ritten_detail", "datum")}, kinds AS (SELECT {R}, kenteken, MAX(voertuigtype) AS kind FROM routes_detail WHERE {PLATE} GROUP BY 1, 2)
         SELECT v.{R}, v.kenteken, inzetdagen, vervoerde_passagiers, drempelwaarde, controlewaarde, COALESCE(k.kind, '') AS kind, inrichting
         FROM ({age_vehicles(13, "CAST(NULL AS VARCHAR)", "''")}) v LEFT JOIN kinds k ON k.{R} = v.{R} AND k.kenteken = v.kenteken
         UNION ALL SELECT {R}, 'Totaal', inzetdagen, passagiers, '', '', '', '' FROM ({age_totals()})""",
         "kenteken inzetdagen vervoerde_passagiers drempelwaarde controlewaarde kind inrichting"),
    20: (DAILY_COST, "datum n_ritten kosten_rit"),
    1004: (f"WITH {stacked(1004)}", "type dimensie category cell totaal percentage"),
    1005: (f"WITH {stacked(1005)}", "type dimensie category cell totaal percentage"),
    1006: (f"""WITH {ages(1006, "va_ritten_detail", "rit_datum")}
         SELECT {R}, kenteken, inzetdagen, vervoerde_passagiers, CAST(drempelwaarde AS VARCHAR) AS drempelwaarde, controlewaarde, '' AS kind, inrichting
         FROM ({age_vehicles(1006, "MAX(dempelwaarde_1006)", "COALESCE(MAX(tekst_1006), '')")})
         UNION ALL SELECT {R}, 'Totaal', inzetdagen, passagiers, '', '', '', '' FROM ({age_totals()})""",
           "kenteken inzetdagen vervoerde_passagiers drempelwaarde controlewaarde kind inrichting"),
}


def quoted(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '[;\"\\r\\n]') THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END"


SHEET_ORDER = {
    1: "datum klant_nummer reiziger_naam", 5: "route_date route_nummer", 8: "-overschrijding datum klant_nummer", 10: "route_key id datum",
    11: "emission_class -rides kenteken", 13: "is_total kenteken", 20: "datum", 1004: "-type dimensie category", 1005: "-type dimensie category",
    1006: "is_total kenteken",
}
SHEET_HEADERS = {
    1: REPORT_1_COLUMNS, 5: REPORT_5_COLUMNS, 8: REPORT_8_COLUMNS, 10: {"route_key": "RouteKey", **REPORT_10_COLUMNS}, 11: REPORT_11_COLUMNS,
    13: {**VEHICLE_AGE_COLUMNS, "kind": VEHICLE_AGE_COLUMNS["type"]}, 20: REPORT_20_COLUMNS, 1004: {}, 1005: {},
    1006: {**VEHICLE_AGE_COLUMNS, "kind": VEHICLE_AGE_COLUMNS["type"]},
}


def ordered(names: str, held: str) -> str:
    """An order by columns, NULLs last; the total of an age sheet stands below its vehicles."""
    terms = []
    for name in names.split():
        bare = name.removeprefix("-")
        term = "kenteken = 'Totaal'" if bare == "is_total" else f'"{bare}"'
        terms.append(f"{term} {'DESC' if name.startswith('-') else 'ASC'} NULLS LAST")
    return ", ".join(terms)


def bundle() -> str:
    """Sheets of every control with headers; generic ride controls have one for each kind of run that has the control's columns."""
    parts = []
    for control in SHEETS:
        if control in SHEET_SQL:
            rows, names = SHEET_SQL[control]
            sheets = [(rows, names, ordered(SHEET_ORDER[control], names), SHEET_HEADERS[control])]
        else:
            both = ["ritten_detail", "va_ritten_detail"] if generic_dataset(control) == "ritten_detail" else [generic_dataset(control)]
            held = [dataset for dataset in both if f"resultaat_{control}" in columns_of(dataset)]
            sheets = []
            for dataset in held:
                shown_names = generic_names(control, dataset)
                day_name = "rit_datum" if dataset == "va_ritten_detail" else "datum"
                more = ", ".join(name for name in (day_name, "vervoerder") if name not in shown_names)
                rows = generic_detail(control, dataset).replace(" FROM ", f"{', ' + more if more else ''} FROM ", 1)
                outcome = ("resultaat", "tekst", "controlewaarde", "dempelwaarde")
                fields = [f"{name}_{control}" if name in outcome else name for name in REPORT_COLUMNS[control]]
                heads = dict(zip(fields, REPORT_COLUMNS[control].values(), strict=True))
                sheets.append((rows, " ".join(shown_names), ordered(f"{day_name} vervoerder", ""), heads))
        for number, (rows, names, order, heads) in enumerate(sheets):
            cells = ", ".join(quoted(shown('"type"' if name == "type" else name)) for name in names.split())
            head = ";".join(heads.get(name, heads.get(name.removesuffix("_s"), name)) for name in names.split()).replace("'", "''")
            name = f"sheet_{control}_{number}"
            parts.append(f"""{name} AS (SELECT *, concat_ws(';', {cells}) AS line FROM ({rows}) AS rows_{control}_{number}),
            {name}_lines AS (SELECT {R}, {control} AS control_id, ROW_NUMBER() OVER (PARTITION BY {R} ORDER BY {order}, line) AS row_no, line FROM {name}
                UNION ALL SELECT DISTINCT {R}, {control}, 0, '{head}' FROM {name})""")
    names = [part.split(" AS ", 1)[0] + "_lines" for part in parts]
    return f"""{", ".join(parts)} SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM {name}" for name in names)}) AS all_lines"""


# Normalising and sync.

CURRENT = f"(SELECT {R} FROM manifest WHERE is_current)"


def prepared(dataset: str, transport: str) -> str:
    held = columns_of(dataset) if dataset != "kentallen_route" else [R, "datum", "route_id", "kosten_rit", "n_ritten"]
    typed = {R: "BIGINT", "perceel": "DOUBLE"}
    listed = ", ".join(f"CAST({name} AS {typed[name]}) AS {name}" if name in typed else name for name in held)
    return f"""SELECT {listed}, 'demo' AS client_slug FROM {dataset}
    WHERE {R} IN (SELECT {R} FROM manifest WHERE is_current AND soortvervoer = '{transport}')"""


DIFF = f"""diff AS (SELECT {R}, CASE WHEN {R} > 200106 THEN 'new' WHEN {R} < 199603 THEN 'expired' ELSE 'retained' END AS status
    FROM run_list)"""
SNAPSHOT_PARTS = {
    "ritten_detail": f"SELECT {R} FROM ritten_detail",
    "routes_detail": f"SELECT {R} FROM routes_detail",
    "kentallen_route": f"SELECT {R} FROM kentallen_route WHERE {R} IN (SELECT {R} FROM run_list WHERE soortvervoer = 'RG')",
    "va_ritten_detail": f"SELECT {R} FROM va_ritten_detail",
    "executed_controls": f"SELECT {R} FROM executed_controls",
    "ritten_controls_long": f"SELECT {R} FROM {LONG_RIDES}",
    "routes_controls_long": f"SELECT {R} FROM {long_rows('routes_detail', 'route')}",
    "va_ritten_controls_long": f"SELECT {R} FROM {LONG_VA}",
}
STORED = "stored AS (" + " UNION ALL ".join(
    f"SELECT '{dataset}' AS dataset, CAST({R} AS BIGINT) AS {R} FROM ({rows})" for dataset, rows in SNAPSHOT_PARTS.items()
) + ")"
KEY_FIGURE_COLUMNS = f"CAST({R} AS BIGINT) AS {R}, datum, route_id, kosten_rit, n_ritten"
AUDIT_COUNTS = f"""{STORED}, manifests AS (
    SELECT 1 AS day, 'manifest' AS dataset, COUNT(*) FILTER (WHERE {R} <= 200106) AS n_current, 0 AS n_history FROM run_list
    UNION ALL SELECT 2, 'manifest', COUNT(*) FILTER (WHERE {R} >= 199603), 0 FROM run_list)
SELECT 1 AS day, dataset, COUNT(*) FILTER (WHERE {R} <= 200106) AS n_current, CAST(0 AS BIGINT) AS n_history FROM stored GROUP BY 2
UNION ALL SELECT 2, dataset, COUNT(*) FILTER (WHERE {R} >= 199603), COUNT(*) FILTER (WHERE {R} < 199603) FROM stored GROUP BY 2
UNION ALL SELECT day, dataset, n_current, n_history FROM manifests"""

TYPED = r"""WITH trimmed AS (
    SELECT l_orderkey, shown, TRIM(shown) AS v, replace(regexp_replace(regexp_replace(replace(TRIM(shown), '.', ''), ',', '.'), '%', ''), ' ', ' ') AS dutch FROM shown_rows),
kinds AS (SELECT *, CASE WHEN v = '' THEN 0 WHEN regexp_full_match(v, '\d{2}-\d{2}-\d{4}') OR regexp_full_match(v, '\d{4}-\d{2}-\d{2}') THEN 1
    WHEN regexp_full_match(v, '\d{1,2}:\d{2}') THEN 2 WHEN regexp_full_match(dutch, '-?\d+(\.\d+)?') THEN 3 ELSE 4 END AS kind FROM trimmed)
SELECT l_orderkey, shown, kind, CASE WHEN kind = 3 THEN CAST(dutch AS DOUBLE) END AS number,
    CASE kind WHEN 1 THEN CASE WHEN regexp_full_match(v, '\d{2}-.*') THEN v[7:10] || '-' || v[4:5] || '-' || v[1:2] ELSE v END
        WHEN 2 THEN lpad(v, 5, '0') WHEN 4 THEN LOWER(v) END AS text FROM kinds"""


def generic_names(control: int, dataset: str) -> list[str]:
    held = columns_of(dataset)
    outcome = ("resultaat", "tekst", "controlewaarde", "dempelwaarde")
    listed = []
    for name in REPORT_COLUMNS[control]:
        name = f"{name}_{control}" if name in outcome else name
        name = name if name in held else f"{name}_s"
        if name in held:
            listed.append(name)
    return listed


def generic_detail(control: int, dataset: str | None = None) -> str:
    dataset = dataset or generic_dataset(control)
    listed = []
    for name in generic_names(control, dataset):
        is_place = name in ("locatie_van", "locatie_naar") and dataset != "routes_detail"
        listed.append(f"{strip(name)} AS {name}" if is_place else name)
    return f"SELECT {R}, {', '.join(listed)} FROM {dataset} WHERE {deviates(control, dataset)}"


def statements() -> dict[str, str]:
    views = sql_views()
    plain: dict[str, str] = {}  # SELECT over the views
    chained: dict[str, str] = {}  # more common table expressions, then a SELECT

    plain["current_run_list"] = f"SELECT {R}, omschrijving, soortvervoer FROM manifest WHERE is_current"
    chained["executed_controls"] = f"""{EXECUTED} SELECT {R}, control_id, omschrijving,
        CAST(control_id AS VARCHAR) || CASE WHEN omschrijving IS NULL THEN '' ELSE ' - ' || omschrijving END AS label
        FROM executed WHERE control_id IS NOT NULL OR omschrijving IS NOT NULL"""
    entities = "kinds(control_id, entity) AS (VALUES " + ", ".join(f"({c}, '{e}')" for c, (_, e, _) in CONTROLS.items()) + ")"
    chained["control_dimension"] = f"""{EXECUTED}, {TITLES}, {entities}
        SELECT {R}, control_id, COALESCE(omschrijving, title) AS control_name, entity, title
        FROM executed JOIN titles USING (control_id) JOIN kinds USING (control_id) WHERE control_id <> 20"""
    plain["controlcode_counts"] = """SELECT CASE WHEN klant_nummer % 11 <> 0 THEN klant_nummer % 11 END AS controlecode, COUNT(*) AS n_rows
        FROM ritten_detail GROUP BY 1"""
    plain["controlcode_row_count"] = "SELECT COUNT(*) AS n_rows FROM ritten_detail"
    newest = f"(SELECT MAX({R}) FROM manifest WHERE is_current)"
    plain["selected_run"] = f"""SELECT {R}, omschrijving, soortvervoer, 'current' AS asked FROM manifest WHERE {R} = 200106
        UNION ALL SELECT {R}, omschrijving, soortvervoer, a FROM manifest, (VALUES ('not current'), ('none')) AS t(a) WHERE {R} = {newest}"""

    chained["control_breakdown"] = f"{BREAKDOWN} SELECT *, {COUNT_PCT} AS deviation_percentage FROM breakdown"
    chained["dashboard_metrics"] = METRICS
    chained["dashboard_metrics_long"] = METRICS
    chained["control_deviation_count"] = f"{measures()} SELECT {R}, dataset, control_id, total_deviations FROM measures"
    chained["control_checked_count"] = f"{measures()} SELECT {R}, dataset, control_id, total_checked FROM measures"
    chained["control_breakdown_stored"] = f"{BREAKDOWN} SELECT *, {COUNT_PCT} AS deviation_percentage FROM breakdown WHERE {R} IN (SELECT {R} FROM runs)"
    chained["dashboard_metrics_stored"] = METRICS
    chained["control_trend_stored"] = f"{TREND} SELECT *, {COUNT_PCT} AS deviation_percentage FROM trend"
    chained["control_trend"] = f"{TREND} SELECT *, {COUNT_PCT} AS deviation_percentage FROM trend"
    chained["trend_previous_point"] = f"""{TREND}, shares AS (SELECT *, {COUNT_PCT} AS percentage FROM trend),
        highest AS (SELECT selected_run, control_id, MAX(total_deviations) AS max_deviations FROM trend GROUP BY 1, 2)
        SELECT h.selected_run, h.control_id, s.{R} AS previous_run, s.total_deviations AS previous_deviations,
            s.total_checked AS previous_checked, s.percentage AS previous_percentage, h.max_deviations
        FROM highest h LEFT JOIN shares s ON s.selected_run = h.selected_run AND s.control_id = h.control_id AND s.position = 1"""
    chained["control_1_trend"] = f"""{POINTS}, counts AS (
        SELECT {R}, COUNT(*) AS n, COUNT(*) FILTER (WHERE {nonzero(1)}) AS d FROM ritten_detail GROUP BY 1
        UNION ALL SELECT {R}, COUNT(*), 0 FROM va_ritten_detail GROUP BY 1)
        SELECT selected_run, 1 AS control_id, CAST(position AS INTEGER) AS position, p.{R}, label, COALESCE(n, 0) AS total_checked,
            COALESCE(d, 0) AS total_deviations, {pct("COALESCE(d, 0)", "COALESCE(n, 0)", 2)} AS deviation_percentage
        FROM points p LEFT JOIN counts c ON c.{R} = p.{R}"""
    plain["drilldown_rows"] = DRILL
    plain["drilldown_total"] = f"SELECT {R}, COUNT(*) AS total_rows FROM ({DRILL}) GROUP BY 1"
    drill_ties = [R, "entity_id", "vervoerder", "perceel", "resultaat", "tekst"]
    plain["drilldown_page"] = paged(DRILL, "datum DESC NULLS LAST, controle_id ASC NULLS LAST", drill_ties, 100, 100)

    plain["report_1_summary"] = summary("ritten_detail", nonzero(1))
    plain["report_1_detail"] = REPORT_1
    ties_1 = [
        R, "locatie_van", "postcode_van", "bestelde_vertrektijd_s", "locatie_naar", "postcode_naar", "bestelde_aankomsttijd_s",
        "match_uitleg", "bedrag_ex_btw", "status_rit", "route_nummer", "perceel_vervoerder",
    ]
    order_1 = "datum ASC NULLS LAST, klant_nummer ASC NULLS LAST, reiziger_naam ASC NULLS LAST"
    plain["report_1_page"] = paged(REPORT_1, order_1, ties_1, 100, 100)
    plain["report_5_summary"] = summary("routes_detail", deviates(5, "routes_detail"))
    plain["report_5_detail"] = REPORT_5
    plain["report_5_route_rides"] = REPORT_5_RIDES
    planned = "geplande_instap_tijd_s IS NOT NULL AND geplande_uitstap_tijd_s IS NOT NULL"
    plain["report_8_summary"] = checked_summary("ritten_detail", planned, nonzero(8))
    plain["report_8_detail"] = REPORT_8
    ties_8 = [
        R, "reiziger_naam", "locatie_van", "locatie_naar", "geplande_instap_tijd_s", "geplande_uitstap_tijd_s", "max_reistijd",
        "geplande_reistijd", "gerealiseerde_instap_tijd_s", "gerealiseerde_uitstap_tijd_s", "real_reistijd",
    ]
    order_8 = "overschrijding DESC NULLS LAST, datum ASC NULLS LAST, klant_nummer ASC NULLS LAST"
    plain["report_8_page"] = paged(REPORT_8, order_8, ties_8, 100, 0)
    plain["report_10_summary"] = checked_summary("routes_detail", "route_nummer IS NOT NULL", nonzero(10))
    plain["report_10_routes"] = ROUTE_LIST
    plain["report_10_default_route"] = f"""SELECT {R}, route_key FROM (SELECT *, ROW_NUMBER() OVER (
        PARTITION BY {R} ORDER BY COALESCE(improvement_minutes, 0) DESC, route_datum DESC NULLS LAST, route_nummer) AS place
        FROM ({ROUTE_LIST})) WHERE place = 1"""
    spans = [("netto_instap_s", "netto_uitstap_s"), ("netto_herplan_instap_s", "netto_herplan_uitstap_s")]
    actual, replanned = (MINUTES.format(f"MIN({start})", f"MAX({end})") for start, end in spans)
    chained["report_10_durations"] = f"""{IMPROVED_RIDES} SELECT {R}, datum, route_nummer, COUNT(*) AS rides,
        {actual} AS actual_minutes, {replanned} AS replanned_minutes FROM improved GROUP BY 1, 2, 3"""
    chained["report_10_stops"] = STOPS
    chained["report_10_detail"] = REPORT_10

    for control, name in GENERIC.items():
        plain[name] = generic_detail(control)
        if control not in (5, 12):
            dataset = generic_dataset(control)
            plain[f"report_{control}_summary"] = summary(dataset, deviates(control, dataset))
    plain["report_12_generic_summary"] = summary("ritten_detail", deviates(12, "ritten_detail"))
    for control in (1004, 1005, 1006):
        keys = f"{R}, kenteken, " + ("rit_datum, controlewaarde_1006, dempelwaarde_1006" if control == 1006 else f"controlewaarde_{control}")
        grouped = f"SELECT {keys}, COUNT(*) AS aantal_ritten FROM va_ritten_detail WHERE {deviates(control, 'va_ritten_detail')} GROUP BY {keys}"
        plain[f"report_{control}_grouped"] = grouped
        plain[f"report_{control}_grouped_count"] = f"SELECT {R}, COUNT(*) AS total_rows FROM ({grouped}) GROUP BY 1"

    plain["report_11_summary"] = summary("ritten_detail", "COALESCE(resultaat_11, 0) > 1", digits=2)
    chained["report_11_classes"] = classes(R)
    chained["report_11_classes_pooled"] = classes("")
    chained["report_11_totals"] = f"{CLASSED} SELECT {R}, COUNT(*) AS classified_rides, SUM(km) > 0 AS has_km FROM classed GROUP BY 1"
    chained["report_11_vehicles"] = f"""{CLASSED} SELECT {R}, kenteken, emission_class, COUNT(DISTINCT datum) AS inzetdagen,
        COUNT(DISTINCT route_nummer) AS routes, COUNT(*) AS rides FROM classed GROUP BY 1, 2, 3"""
    chained["report_11_vehicle_count"] = f"""{CLASSED} SELECT {R}, COUNT(*) AS total_rows FROM (
        SELECT {R}, kenteken, emission_class FROM classed GROUP BY 1, 2, 3) GROUP BY 1"""
    plain["report_12_summary"] = summary("ritten_detail", FUEL, digits=2)
    plain["report_12_fuels"] = f"SELECT DISTINCT {R}, controlewaarde_12 AS fuel_type FROM ritten_detail WHERE {FUEL}"
    chained["report_12_daily"] = f"{fuel_matrix('datum')} SELECT {R}, {FUEL_SELECT}"
    month = "strftime(datum, '%Y-%m')"
    chained["report_12_monthly"] = f"{fuel_matrix(month)} SELECT {R}, {FUEL_SELECT}"
    chained["report_12_monthly_pooled"] = f"{fuel_matrix(month, by=False)} SELECT {FUEL_SELECT}"
    wide = ", ".join(
        f"COALESCE(MAX(CASE WHEN fuel_type = '{fuel}' THEN rides END), 0) AS \"{fuel} aantal\", "
        f"COALESCE(MAX(CASE WHEN fuel_type = '{fuel}' THEN percentage END), 0) AS \"{fuel} %\""
        for fuel in ("Benzine", "Diesel", "Elektrisch")
    )
    chained["export_12_monthly_wide"] = f"""{fuel_matrix(month)}, shares AS (SELECT {R}, {FUEL_SELECT})
        SELECT {R}, period, {wide}, MAX(total) AS "Totaal" FROM shares GROUP BY 1, 2"""

    aged = ages(13, "ritten_detail", "datum")
    chained["report_13_summary"] = f"{aged} {age_summary(13)}"
    chained["report_13_vehicles"] = f"""{aged}, kinds AS (SELECT {R}, kenteken, MAX(voertuigtype) AS kind FROM routes_detail WHERE {PLATE} GROUP BY 1, 2)
        SELECT v.*, COALESCE(k.kind, '') AS "type" FROM ({age_vehicles(13, "CAST(NULL AS VARCHAR)", "''")}) v
        LEFT JOIN kinds k ON k.{R} = v.{R} AND k.kenteken = v.kenteken"""
    chained["report_13_totals"] = f"{aged} {age_totals()}"
    plain["report_13_age_histogram"] = age_histogram(13, "ritten_detail")
    va_aged = ages(1006, "va_ritten_detail", "rit_datum")
    chained["report_1006_summary"] = f"{va_aged} {age_summary(1006)}"
    chained["report_1006_vehicles"] = f"""{va_aged} SELECT *, '' AS "type"
        FROM ({age_vehicles(1006, "MAX(dempelwaarde_1006)", "COALESCE(MAX(tekst_1006), '')")})"""
    chained["report_1006_totals"] = f"{va_aged} {age_totals()}"
    plain["report_1006_age_histogram"] = age_histogram(1006, "va_ritten_detail")

    for control in (1004, 1005):
        plain[f"report_{control}_summary"] = summary("va_ritten_detail", nonzero(control))
        chained[f"report_{control}_classes"] = f"{fleet(control)} SELECT DISTINCT {R}, category FROM fleet"
        chained[f"report_{control}_weekly"] = f"{weekly(control)} SELECT * FROM weekly"
        chained[f"report_{control}_trips"] = f"{fleet(control)}, {TRIPS} SELECT * FROM trips"
        chained[f"report_{control}_distance"] = f"{fleet(control)}, {DISTANCE} SELECT * FROM distances"
        chained[f"export_{control}_stacked"] = stacked(control)
    heads = ", ".join(f"COALESCE(MAX(CASE WHEN category = '{head}' THEN vehicles END), 0) AS \"{head}\"" for head in ("5", "6", "6/6", "EEV", "Z", "Z/Z"))
    chained["export_1004_weekly_wide"] = f'{weekly(1004)} SELECT {R}, iso_week, {heads}, MAX(total) AS "Totaal" FROM weekly GROUP BY 1, 2'

    plain["report_20_summary"] = f"""SELECT {R}, n AS total_checked, c AS days_with_cost, {pct("c", "n", 2)} AS coverage_percentage, average_cost, total_rides
        FROM (SELECT {R}, COUNT(*) AS n, COUNT({COST}) AS c, {MEAN_COST} AS average_cost, CAST(SUM({COUNTED}) AS BIGINT) AS total_rides
              FROM kentallen_route GROUP BY 1)"""
    plain["report_20_daily_table"] = DAILY_COST
    plain["report_20_daily_chart"] = f"SELECT {R}, datum, kosten_rit FROM ({DAILY_COST}) WHERE datum IS NOT NULL"
    chained["report_20_monthly"] = f"""anchors AS (SELECT {R}, MAX(datum) AS last_day FROM kentallen_route GROUP BY 1),
        months AS (SELECT DATE_TRUNC('month', datum) AS m, {MEAN_COST} AS kosten_rit FROM kentallen_route WHERE datum IS NOT NULL GROUP BY 1)
        SELECT a.{R}, strftime(m, '%Y-%m') AS "month", kosten_rit FROM anchors a JOIN months
        ON m >= DATE_TRUNC('month', last_day) - INTERVAL 11 MONTH AND m < DATE_TRUNC('month', last_day) + INTERVAL 1 MONTH"""

    three = pct("total_deviations", "total_checked", 3)
    chained["export_summary"] = f"""{BREAKDOWN}, rounded AS (
        SELECT *, CASE WHEN control_id = 11 THEN {COUNT_PCT} ELSE {three} END AS p,
            ROW_NUMBER() OVER (PARTITION BY {R}, control_id ORDER BY control_name) AS copy FROM breakdown)
        SELECT {R}, control_id, control_name, total_checked, total_deviations, printf('%.2f', p) || '%' AS deviation_percentage,
            'control.' || control_id || CASE WHEN copy > 1 THEN '_' || copy ELSE '' END AS sheet FROM rounded"""
    chained["export_bundle_long"] = bundle()
    names_10 = [R, *SHEET_SQL[10][1].split()]
    plain["export_10_all_routes"] = f"SELECT {', '.join(f'{shown(name)} AS {name}' for name in names_10)} FROM (WITH {REPORT_10})"
    plain["format_export_columns"] = f"SELECT {', '.join(f'{shown(name)} AS {name}' for name in REPORT_8_SOURCE)} FROM ritten_detail"
    plain["strip_location_code"] = f"SELECT {R}, id, {strip('locatie_van')} AS locatie FROM ritten_detail".replace(f"{R}, ", "")
    plain["minutes_labels"] = f"""SELECT real_reistijd, rides, CASE WHEN real_reistijd IS NULL THEN 'n.v.t.'
        WHEN real_reistijd // 60 <> 0 THEN printf('%du %02dm', real_reistijd // 60, real_reistijd % 60)
        ELSE printf('%d min', real_reistijd % 60) END AS label
        FROM (SELECT real_reistijd, COUNT(*) AS rides FROM ({REPORT_8}) GROUP BY 1)"""
    chained["typed_sort"] = f"shown_rows AS (SELECT l_orderkey, {SHOWN_TEXT} AS shown FROM lineitem) SELECT * FROM ({TYPED})"

    chained["typed_sort_rows"] = f"""shown_rows AS (SELECT l_orderkey, l_linenumber, l_returnflag, {SHOWN_TEXT} AS shown,
            l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS position FROM lineitem),
        keyed AS (SELECT s.*, t.kind, t.number, t.text FROM shown_rows s JOIN (SELECT DISTINCT shown, kind, number, text FROM ({TYPED})) t USING (shown))
        SELECT l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_linenumber ORDER BY kind DESC, number DESC NULLS LAST, text DESC NULLS LAST,
            LOWER(l_returnflag), position) AS place, shown, l_returnflag, position FROM keyed"""

    scanned = f"id, CAST({R} AS BIGINT) AS {R}, klant_nummer, bedrag_ex_btw, netto_instap_s"
    plain["source_table_scan"] = f"SELECT {scanned.replace(f'CAST({R} AS BIGINT) AS {R}', R)} FROM ritten_detail"
    plain["run_filtered_scan"] = f"SELECT {scanned} FROM ritten_detail WHERE {R} IN {CURRENT}"
    plain["current_runs"] = f"""SELECT CAST({R} AS BIGINT) AS {R}, CAST(NULL AS VARCHAR) AS omschrijving, soortvervoer
        FROM run_list WHERE {R} % 100 <> 7"""
    plain["snake_case_columns"] = """SELECT o_orderkey AS klant_nummer, o_totalprice AS bedrag_ex_btw, o_orderpriority AS resultaat_1,
        o_orderstatus AS resultaat1, CAST(o_orderdate AS DATE) AS datum_rit FROM orders"""
    plain["with_sync_metadata"] = f"""SELECT id AS rit_id, CAST({R} AS BIGINT) AS {R}, 'demo' AS client_slug, '2024-01-02 03:04:05' AS synced_at
        FROM ritten_detail"""
    plain["resolve_aliases"] = """SELECT l_orderkey AS rit_nr, l_suppkey AS perceelnummer, l_partkey AS perceel, CAST(l_shipdate AS DATE) AS datum,
        l_extendedprice AS bedrag, l_linestatus AS executed, l_orderkey AS rit_id, CAST(l_shipdate AS DATE) AS ritdatum,
        l_extendedprice AS afwijkingsbedrag, l_linestatus AS uitgevoerd FROM base"""
    plain["coerce_types"] = """SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN CAST(l_shipdate AS DATE) END AS datum,
        CASE WHEN l_linenumber <> 2 THEN l_partkey END AS id,
        CASE WHEN l_linenumber <> 4 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) END AS bedrag_ex_btw,
        CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber = 1 THEN l_suppkey + 0.5::DOUBLE ELSE CAST(l_suppkey AS DOUBLE) END AS perceel,
        l_linenumber IN (1, 2, 3, 4) AS uitgevoerd FROM lineitem"""
    plain["prepare_rides"] = prepared("ritten_detail", "RG")
    plain["prepare_routes"] = prepared("routes_detail", "RG")
    plain["prepare_key_figures"] = prepared("kentallen_route", "RG")
    plain["prepare_va_rides"] = prepared("va_ritten_detail", "VA")
    plain["executed_controls_join"] = f"""SELECT CAST(x.{R} AS BIGINT) AS {R}, x.controle_id, x.controlecode AS controle_code_done,
        CASE WHEN x.uitgevoerd THEN 'Ja' ELSE 'nee' END AS done, c.omschrijving
        FROM executed_controls x LEFT JOIN ({CONTROL_PLAN}) c ON c.controle_id = x.controle_id WHERE x.{R} IN {CURRENT}"""
    plain["prepare_executed_controls"] = f"""SELECT CAST(x.{R} AS BIGINT) AS {R}, CAST(x.controle_id AS BIGINT) AS controle_id,
        CAST(x.controle_id AS BIGINT) AS controlecode, c.omschrijving, x.uitgevoerd, 'demo' AS client_slug
        FROM executed_controls x LEFT JOIN ({CONTROL_PLAN}) c ON c.controle_id = x.controle_id WHERE x.{R} IN {CURRENT}"""
    plain["control_unpivot"] = f"SELECT * FROM {LONG_RIDES}"
    plain["control_unpivot_va"] = f"SELECT * FROM {LONG_VA}"
    plain["control_unpivot_routes"] = f"SELECT * FROM {long_rows('routes_detail', 'route')}"
    plain["deviation_flag"] = f"""SELECT l_orderkey, resultaat, {flag("resultaat")} AS is_deviation
        FROM (SELECT l_orderkey, {RESULT_TEXT} AS resultaat FROM lineitem)"""
    plain["infer_column_types"] = """SELECT l_orderkey AS whole, l_extendedprice AS money,
        CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS number,
        CASE WHEN l_linenumber = 7 THEN 'n.v.t.' ELSE CAST(l_partkey AS VARCHAR) END AS mixed,
        CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS gaps, CAST(NULL AS VARCHAR) AS empty, l_returnflag AS words FROM lineitem"""

    chained["run_diff"] = f"{DIFF} SELECT {R}, status FROM diff"
    plain["split_runs_by_transport"] = f"SELECT {R}, soortvervoer AS transport_group FROM run_list"
    plain["merge_current"] = f"""SELECT {R}, datum, route_id, CASE WHEN {R} <= 200106 THEN kosten_rit END AS kosten_rit,
        CASE WHEN {R} > 200106 THEN n_ritten END AS n_ritten FROM kentallen_route WHERE {R} >= 199603"""
    plain["manifest_build"] = f"""SELECT 'demo' AS client_slug, CAST({R} AS BIGINT) AS {R}, omschrijving, soortvervoer, TRUE AS is_current,
        '2024-01-02 03:04:05' AS sync_timestamp FROM manifest"""
    stored = f"FROM kentallen_route WHERE {R} IN {CURRENT}"
    plain["current_dataset_write"] = f"SELECT CAST({R} AS BIGINT) AS {R}, COUNT(*) AS n_rows {stored} GROUP BY 1"
    plain["current_dataset_read"] = f"SELECT {KEY_FIGURE_COLUMNS} {stored}"
    plain["kentallen_backfill"] = f"SELECT {KEY_FIGURE_COLUMNS} {stored}"
    plain["history_append"] = f"""SELECT 2024 AS "year", 1 AS "month", CASE WHEN {R} % 100 = 12 THEN 'unknown' ELSE CAST({R} AS VARCHAR) END AS {R},
        COUNT(*) AS n_rows FROM kentallen_route GROUP BY ALL"""
    chained["sync_snapshot"] = f"""{STORED} SELECT dataset, CASE WHEN {R} >= 199603 THEN 'current' ELSE 'history' END AS area, {R}, COUNT(*) AS n_rows
        FROM stored GROUP BY ALL"""
    plain["expire_to_history"] = f"""SELECT {KEY_FIGURE_COLUMNS} FROM kentallen_route WHERE {R} < 199603
        AND {R} IN (SELECT {R} FROM run_list WHERE soortvervoer = 'RG')"""
    chained["sync_audit_counts"] = AUDIT_COUNTS
    plain["latest_sync"] = """SELECT client_slug, started_at, status, records_synced FROM (
        SELECT o_orderpriority AS client_slug, o_orderkey AS started_at, o_orderstatus AS status, o_custkey AS records_synced,
            ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS place FROM orders) WHERE place = 1"""
    plain["deviations_per_vervoerder"] = f"""SELECT {R}, vervoerder, COUNT(DISTINCT entity_id) AS entities FROM {LONG_RIDES}
        WHERE is_deviation GROUP BY 1, 2"""
    plain["deviations_per_vervoerder_rg_va"] = f"""SELECT {R}, vervoerder, CAST(SUM(n) AS BIGINT) AS entities FROM (
        SELECT {R}, vervoerder, COUNT(DISTINCT entity_id) AS n FROM {LONG_RIDES} WHERE is_deviation GROUP BY 1, 2
        UNION ALL SELECT {R}, vervoerder, COUNT(DISTINCT entity_id) FROM {LONG_VA} WHERE is_deviation GROUP BY 1, 2) GROUP BY 1, 2"""
    flagged = " OR ".join(nonzero(int(name.split("_")[1])) for name in RG_COLUMNS if name.startswith("resultaat_"))
    plain["deviation_amount"] = f"""SELECT {R}, ROUND(COALESCE(SUM(CASE WHEN {flagged} THEN bedrag_ex_btw END), 0), {AMOUNT_DIGITS})
        AS deviation_amount FROM ritten_detail GROUP BY 1"""
    plain["history_dedupe"] = """SELECT entity_id, controle_id, resultaat, synced_at, stuurtabel_id FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY stuurtabel_id, entity_id, controle_id ORDER BY synced_at DESC) AS place FROM (
            SELECT o_custkey AS entity_id, l_linenumber AS controle_id, l_returnflag AS resultaat,
                l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey AS synced_at, l_quantity % 3 AS stuurtabel_id FROM base))
        WHERE place = 1"""

    return {
        **{name: f"WITH {views} {sql}" for name, sql in plain.items()},
        **{name: f"WITH {views}, {sql}" for name, sql in chained.items()},
    }
