"""Domain datasets derived from the star-schema test tables.

Each dataset is a set of plain SQL column expressions over ``lineitem`` and its
dimensions. The expressions read the same in Spark SQL and in the SQL used to
check results, so both sides start from one definition of the input; nothing of
the report logic is in here.

A dataset is asked for with the columns a query needs. Only the dimensions those
columns come from are joined: the keys of the star schema are foreign keys, so a
dimension that contributes no column would neither drop nor repeat a row.
Join strategies are left to Catalyst and its size checks.

A query that reads several datasets asks for them ``sharing`` one join of lineitem and orders: the exchanges below
it are then the same for all, so Spark shuffles the two largest tables once instead of once for each dataset.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = {
    "o": ("orders", "o_orderkey = l_orderkey"),
    "c": ("customer", "c_custkey = o_custkey"),
    "p": ("part", "p_partkey = l_partkey"),
    "s": ("supplier", "s_suppkey = l_suppkey"),
}

RUN_ID = "cast(extract(year from o_orderdate) as int) * 100 + cast(extract(month from o_orderdate) as int)"
TRANSPORT = f"case when ({RUN_ID}) % 100 % 3 = 0 then 'VA' else 'RG' end"
PLANNED_IN = "l_partkey * 37 % 70000"

RIDE_GENERIC = [2, 3, 7, 9, 12, 14, 15, 16, 17, 18, 19, 21, 22, 23, 24]
VA_GENERIC = [1001, 1002, 1003, 1007, 1008]
ROUTE_GENERIC = [3, 7, 14, 15, 21]


def _generic(control: int) -> dict[str, str]:
    return {
        f"resultaat_{control}": f"case when (l_partkey + {control * 7}) % 10 = 0 then null "
        f"when (l_partkey * {control} + l_linenumber) % 13 = 0 then 1 else 0 end",
        f"tekst_{control}": f"case when (l_suppkey + l_linenumber + {control}) % 19 = 0 "
        f"then concat('Afwijking ', cast({control} as string)) end",
    }


RIDES: dict[str, str] = {
    "id": "l_orderkey * 10 + l_linenumber",
    "stuurtabel_id": RUN_ID,
    "soortvervoer": TRANSPORT,
    "datum": "case when l_linenumber = 7 then null else cast(o_orderdate as date) end",
    # Routes are what a supplier's vehicle drives on a day, so their number grows with the suppliers.
    "route_nummer": "concat('R', cast(l_suppkey % 5 + 10 * cast(floor(l_suppkey / 100) as bigint) as string))",
    "kenteken": "case when l_partkey % 13 = 0 then null when l_partkey % 11 = 0 then '00-00-00' "
    "when l_partkey % 17 = 0 then '  ' else concat('NL-', lpad(cast(l_partkey % 40 as string), 3, '0')) end",
    "klant_nummer": "o_custkey",
    "reiziger_naam": "c_name",
    "locatie_van": "concat(lpad(cast(c_nationkey as string), 5, '0'), '  ', p_name)",
    "locatie_naar": "p_name",
    "postcode_van": "concat(cast(1000 + o_custkey % 8999 as string), 'AB')",
    "postcode_naar": "concat(cast(1000 + l_partkey % 8999 as string), 'CD')",
    "plaats_van": "concat('G', cast(o_custkey % 17 as string))",
    "plaats_naar": "case when l_linenumber = 5 then null else concat('G', cast(l_partkey % 19 as string)) end",
    "richting": "case when l_linestatus = 'O' then 'HEEN' else 'TERUG' end",
    "status_rit": "case when l_discount > 0.08 then null when l_linestatus = 'O' then 'Gereden' else 'Loosmelding' end",
    "afwezigheids_melding": "case when l_tax > 0.06 then 'Afgemeld' end",
    "vervoerder": "concat('V', cast(s_nationkey as string))",
    "perceel": "l_suppkey % 4",
    "perceel_vervoerder": "concat(cast(l_suppkey % 4 as string), '-V', cast(s_nationkey as string))",
    "geplande_instap_tijd_s": f"cast({PLANNED_IN} as int)",
    "geplande_uitstap_tijd_s": f"case when l_linenumber = 6 then null else cast({PLANNED_IN} + l_quantity * 97 as int) end",
    "gerealiseerde_instap_tijd_s": f"case when l_returnflag = 'A' then null else cast({PLANNED_IN} + 45 as int) end",
    "gerealiseerde_uitstap_tijd_s": f"case when l_returnflag = 'A' then null else cast({PLANNED_IN} + l_quantity * 101 as int) end",
    "bestelde_vertrektijd_s": f"case when l_linenumber = 2 then null else cast({PLANNED_IN} + 30 as int) end",
    "bestelde_aankomsttijd_s": f"case when l_linenumber = 4 then null else cast({PLANNED_IN} + l_quantity * 95 as int) end",
    "netto_instap_s": f"cast({PLANNED_IN} + 60 as int)",
    "netto_uitstap_s": f"cast({PLANNED_IN} + l_quantity * 90 as int)",
    "netto_herplan_instap_s": "case when l_discount < 0.03 then null else cast(l_partkey * 31 % 70000 as int) end",
    "netto_herplan_uitstap_s": "case when l_discount < 0.03 then null else cast(l_partkey * 31 % 70000 + l_quantity * 80 as int) end",
    "latitude_van": "cast(50 as double) + cast(l_partkey % 1000 as double) / cast(500 as double)",
    "longitude_van": "cast(4 as double) + cast(l_suppkey % 100 as double) / cast(50 as double)",
    "latitude_naar": "case when l_linenumber = 3 then null else cast(50 as double) + cast(o_custkey % 1000 as double) / cast(500 as double) end",
    "longitude_naar": "cast(4 as double) + cast(c_nationkey % 25 as double) / cast(12.5 as double)",
    "resultaat_1": "case when l_linenumber = 5 then null when l_returnflag = 'R' then 1 else 0 end",
    "tekst_1": "case when l_returnflag = 'R' then 'Niet gevonden in planning' end",
    "resultaat_8": "case when l_quantity > 40 then 1 else 0 end",
    "dempelwaarde_8": "30 + l_linenumber",
    "controlewaarde_8": "cast(l_quantity as int)",
    "resultaat_11": "case when l_tax >= 0.07 then 2 when l_tax >= 0.04 then 1 when l_tax >= 0.01 then 0 end",
    "controlewaarde_11": "case p_size % 7 when 0 then 'Z' when 1 then 'Z/Z' when 2 then '6' when 3 then '6/6' when 4 then '5' when 5 then 'EEV' end",
    "controlewaarde_12": "case p_size % 5 when 0 then 'Diesel' when 1 then 'Elektrisch' when 2 then 'Benzine' when 3 then ' ' end",
    "controlewaarde_13": "case when p_size % 9 = 0 then null when p_size % 9 = 1 then 'onbekend' else cast(p_size % 9 as string) end",
    "km_tarief": "l_quantity",
    "extrakm_rolstoel": "case when l_linenumber > 3 then null else l_quantity / cast(2 as double) end",
    "bedrag_ex_btw": "l_extendedprice",
    "afstand_direct": "l_quantity * cast(1.5 as double)",
}
for _control in RIDE_GENERIC + VA_GENERIC:
    RIDES.update(_generic(_control))

VA_ONLY = {f"{kind}_{control}" for control in VA_GENERIC for kind in ("resultaat", "tekst")}
RG_COLUMNS = [name for name in RIDES if name not in VA_ONLY and name != "afstand_direct"]

VA_RIDES: dict[str, str] = {
    name: RIDES[name]
    for name in (
        "id", "stuurtabel_id", "kenteken", "klant_nummer", "vervoerder", "perceel", "afstand_direct",
        "plaats_van", "postcode_van", "postcode_naar", "bestelde_vertrektijd_s",
        "gerealiseerde_instap_tijd_s", "gerealiseerde_uitstap_tijd_s", "resultaat_2", "tekst_2", *sorted(VA_ONLY),
    )
} | {
    "rit_datum": RIDES["datum"],
    "klantnaam": RIDES["reiziger_naam"],
    "rit_status": RIDES["status_rit"],
    "ritnummer": RIDES["id"],
    "resultaat_1004": f"case when ({RIDES['controlewaarde_11']}) is null then null when ({RIDES['controlewaarde_11']}) = 'EEV' then 2 else 0 end",
    "controlewaarde_1004": RIDES["controlewaarde_11"],
    "resultaat_1005": f"case when ({RIDES['controlewaarde_12']}) = 'Diesel' then 1 else 0 end",
    "controlewaarde_1005": RIDES["controlewaarde_12"],
    "resultaat_1006": RIDES["resultaat_8"],
    "dempelwaarde_1006": "8",
    "controlewaarde_1006": RIDES["controlewaarde_13"],
    "tekst_1006": "case when l_quantity > 35 then p_type end",
}

ROUTE_KEYS = ["stuurtabel_id", "datum", "route_nummer"]
# dataset column -> (ride columns it needs besides the keys, aggregate over them)
ROUTES: dict[str, tuple[list[str], str]] = {
    "id": (["id"], "min(id)"),
    "kenteken": (["kenteken"], "min(kenteken)"),
    "voertuigtype": (["voertuigtype"], "max(voertuigtype)"),
    "vervoerder": (["vervoerder"], "min(vervoerder)"),
    "route_naam": (["locatie_naar"], "min(locatie_naar)"),
    "postcode_eerste": (["postcode_van"], "min(postcode_van)"),
    "postcode_laatste": (["postcode_naar"], "max(postcode_naar)"),
    "aantal_lopers": ([], "count(*)"),
    "aantal_rollers": (["resultaat_8"], "cast(sum(resultaat_8) as bigint)"),
    "resultaat_10": ([], "case when count(*) >= 6 then 1 when count(*) = 1 then null else 0 end"),
    "controlewaarde_10": (["controlewaarde_8"], "case when count(*) >= 4 then cast(sum(controlewaarde_8) as bigint) end"),
    "resultaat_5": (["resultaat_8"], "case when sum(resultaat_8) > 2 then 1 else 0 end"),
    "tekst_5": (["resultaat_8"], "case when sum(resultaat_8) > 1 then 'Planning niet mogelijk' end"),
}
for _control in ROUTE_GENERIC:
    ROUTES[f"resultaat_{_control}"] = ([f"resultaat_{_control}"], f"max(resultaat_{_control})")
    # The message of a control is the same text wherever there is one, so counting finds it.
    ROUTES[f"tekst_{_control}"] = (
        [f"tekst_{_control}"],
        f"case when count(tekst_{_control}) > 0 then concat('Afwijking ', cast({_control} as string)) end",
    )

# Cost in thousands with two decimals, rounded half up on whole cents, so that no engine's
# own way to round a double shows in the input.
HUNDREDTHS = "cast(floor((cast(round(sum(l_extendedprice) * 100) as bigint) + 500) / 1000) as bigint)"
KEY_FIGURES = {
    "kosten_rit": "case when l_suppkey % 7 = 0 then 'n.v.t.' when l_suppkey % 5 = 0 then null "
    f"else concat(cast(cast(floor({HUNDREDTHS} / 100) as bigint) as string), '.', "
    f"lpad(cast({HUNDREDTHS} % 100 as string), 2, '0')) end",
    "n_ritten": "case when l_suppkey % 9 = 0 then null else cast(count(*) as string) end",
}

KEY_FIGURE_ROWS = ["l_shipdate", "l_suppkey", "l_extendedprice"]

# controle_id, controlecode, omschrijving, transport
CONTROL_PLAN = """
    select * from (values
        (1, 1, 'Bestelling ook in planning', 'RG'), (5, null, 'Planning mislukt', 'RG'),
        (8, 8, 'Overschrijden reistijd', 'RG'), (9, 9, 'Stiptheid', 'RG'), (10, 10, null, 'RG'),
        (11, 11, 'Emissieklasse', 'RG'), (20, 20, 'Kosten per rit', 'RG'),
        (1004, 1004, 'Emissie', 'VA'), (1005, 1005, 'Brandstof', 'VA'), (1006, 1006, 'Leeftijd', 'VA')
    ) as plan(controle_id, controlecode, omschrijving, transport)
"""


def _columns(expressions: Iterable[str]) -> set[str]:
    """Columns of lineitem and orders that the expressions need, with the keys of the other tables they mention."""
    text = " ".join(expressions)
    keys = {"c": "o_custkey", "p": "l_partkey", "s": "l_suppkey"}
    return {*re.findall(r"\b[lo]_[a-z]+\b", text)} | {key for prefix, key in keys.items() if re.search(rf"\b{prefix}_[a-z]", text)}


class Star:
    """The test tables of one folder, as the domain datasets."""

    def __init__(self, spark: SparkSession, folder: str, shared: tuple[str, ...] = ()):
        self.spark = spark
        self.folder = folder
        self.shared = shared

    def sharing(self, expressions: Iterable[str]) -> Star:
        """The same tables, whose datasets share one join of lineitem and orders where its columns are enough for them."""
        return Star(self.spark, self.folder, tuple(sorted(_columns([*expressions, TRANSPORT]))))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def base(self, expressions: Iterable[str]) -> DataFrame:
        """``lineitem`` joined to the dimensions that the expressions mention."""
        needed = " ".join(expressions)
        used = set(re.findall(r"\b([ocps])_[a-z]", needed))
        if "c" in used:
            used.add("o")
        joined = self.table("lineitem")
        if "o" in used and _columns([needed]) <= {*self.shared}:
            # A generator hands on all its columns. Were they pruned to what each dataset reads, no exchange would be like another.
            joined = joined.join(self.table("orders"), F.expr(DIMENSIONS["o"][1])).select(F.inline(F.array(F.struct(*self.shared))))
            used.remove("o")
        for prefix, (name, condition) in DIMENSIONS.items():
            if prefix in used:
                joined = joined.join(self.table(name), F.expr(condition))
        return joined

    def _project(self, expressions: dict[str, str], transport: str | None) -> DataFrame:
        rows = self.base([*expressions.values(), TRANSPORT])
        if transport:
            rows = rows.where(F.expr(f"{TRANSPORT} = '{transport}'"))
        return rows.selectExpr(*[f"{sql} as {name}" for name, sql in expressions.items()])

    def rides(self, columns: Iterable[str] | None = None, transport: str | None = None) -> DataFrame:
        names = list(dict.fromkeys(["stuurtabel_id", *(columns or RIDES)]))
        return self._project({name: RIDES[name] for name in names}, transport)

    def ritten_detail(self, columns: Iterable[str] | None = None) -> DataFrame:
        return self.rides(RG_COLUMNS if columns is None else columns, "RG")

    def va_ritten_detail(self, columns: Iterable[str] | None = None) -> DataFrame:
        names = list(dict.fromkeys(["stuurtabel_id", *(columns or VA_RIDES)]))
        return self._project({name: VA_RIDES[name] for name in names}, "VA")

    def routes_detail(self, columns: Iterable[str] | None = None) -> DataFrame:
        names = [name for name in (columns or ROUTES) if name not in ROUTE_KEYS]
        needed = dict.fromkeys([*ROUTE_KEYS, *(ride for name in names for ride in ROUTES[name][0])])
        source = {name: RIDES.get(name, "p_type") for name in needed}
        grouped = self._project(source, "RG").groupBy(*ROUTE_KEYS)
        if not names:
            return grouped.agg(F.count("*").alias("n")).drop("n")
        return grouped.agg(*[F.expr(ROUTES[name][1]).alias(name) for name in names])

    def kentallen_route(self) -> DataFrame:
        rows = self.base([RUN_ID, *KEY_FIGURE_ROWS]).selectExpr(f"{RUN_ID} as stuurtabel_id", "cast(l_shipdate as date) as datum", *KEY_FIGURE_ROWS[1:])
        return (
            rows.groupBy("stuurtabel_id", "datum", "l_suppkey")
            .agg(*[F.expr(sql).alias(name) for name, sql in KEY_FIGURES.items()])
            .withColumnRenamed("l_suppkey", "route_id")
        )

    def run_list(self) -> DataFrame:
        return self.rides(["soortvervoer"]).distinct()

    def manifest(self) -> DataFrame:
        return self.run_list().selectExpr(
            "stuurtabel_id",
            "case when stuurtabel_id % 100 = 12 then null else concat('Factuur ', cast(stuurtabel_id as string)) end as omschrijving",
            "soortvervoer",
            "stuurtabel_id >= 199601 as is_current",
        )

    def executed_controls(self) -> DataFrame:
        plan = self.spark.sql(CONTROL_PLAN)
        return self.run_list().join(plan, F.col("soortvervoer") == F.col("transport")).selectExpr(
            "stuurtabel_id", "controlecode", "controle_id", "omschrijving", "controle_id % 9 <> 0 as uitgevoerd"
        )


def _listed(expressions: dict[str, str]) -> str:
    return ",\n".join(f"{sql} AS {name}" for name, sql in expressions.items())


def sql_views() -> str:
    """The same datasets as common table expressions for the checking engine."""
    routes = ",\n".join(f"{sql} AS {name}" for name, (_, sql) in ROUTES.items())
    return f"""base AS (
    SELECT * FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
rides AS (SELECT {_listed(RIDES)}, p_type AS voertuigtype FROM base),
ritten_detail AS (SELECT {", ".join(RG_COLUMNS)}, voertuigtype FROM rides WHERE soortvervoer = 'RG'),
va_ritten_detail AS (SELECT {_listed(VA_RIDES)} FROM base WHERE {TRANSPORT} = 'VA'),
routes_detail AS (SELECT {", ".join(ROUTE_KEYS)}, {routes} FROM ritten_detail GROUP BY {", ".join(ROUTE_KEYS)}),
kentallen_route AS (
    SELECT {RUN_ID} AS stuurtabel_id, cast(l_shipdate as date) AS datum, l_suppkey AS route_id, {_listed(KEY_FIGURES)}
    FROM base GROUP BY 1, 2, 3),
run_list AS (SELECT DISTINCT stuurtabel_id, soortvervoer FROM rides),
manifest AS (
    SELECT stuurtabel_id,
        CASE WHEN stuurtabel_id % 100 <> 12 THEN 'Factuur ' || stuurtabel_id END AS omschrijving,
        soortvervoer, stuurtabel_id >= 199601 AS is_current
    FROM run_list),
executed_controls AS (
    SELECT stuurtabel_id, controlecode, controle_id, omschrijving, controle_id % 9 <> 0 AS uitgevoerd
    FROM run_list JOIN ({CONTROL_PLAN}) ON soortvervoer = transport)"""
