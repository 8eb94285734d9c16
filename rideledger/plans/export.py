"""Exports: workbook summary, one sheet per control, wide matrices, CSV folders."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideledger.fixed_values import (
    GROUPED_COLUMNS,
    REPORT_1_COLUMNS,
    REPORT_5_COLUMNS,
    REPORT_8_COLUMNS,
    REPORT_10_COLUMNS,
    REPORT_11_COLUMNS,
    REPORT_20_COLUMNS,
    STACKED_HEADERS,
    STACKED_LABELS,
    TOTAL_LABEL,
    VEHICLE_AGE_COLUMNS,
)
from rideledger.functions.numeric import half_even, share
from rideledger.functions.text import cell, plain_number
from rideledger.operators.count import PER_RUN, only_run
from rideledger.operators.detail import Detail, format_cells, numbered, ordering, rank
from rideledger.plans.fleet import (
    age_totals,
    age_vehicles,
    fleet_distance,
    fleet_trips,
    fleet_weekly,
    report_11_vehicles,
    report_12_daily,
    report_12_monthly,
    vehicle_types,
    vehicles_by_age,
)
from rideledger.plans.costs import report_20_daily_table
from rideledger.plans.rides import (
    generic_detail,
    generic_fields,
    generic_parts,
    grouped_detail,
    report_1_detail,
    report_1_parts,
    report_5_detail,
    report_5_parts,
    report_8_detail,
    report_8_parts,
)
from rideledger.plans.routes import report_10_detail
from rideledger.plans.sync import transport_group
from rideledger.registry import RUN, detail_dataset, report_columns

SEPARATOR = ";"
TRANSPORTS = ("RG", "VA")
# Decimals of the percentage in each report summary, where not three.
SUMMARY_DIGITS = {11: 2}
# Decimals of mean costs in a sheet: as text the last digits of a double would differ from engine to engine.
COST_DIGITS = 9


def export_summary(breakdown: DataFrame) -> DataFrame:
    """Workbook front page: checked, deviations and percentage of every executed control, with its sheet name."""
    again = Window.partitionBy(RUN, "control_id").orderBy("control_name")
    suffix = F.row_number().over(again)
    sheet = F.concat(F.lit("control."), F.col("control_id").cast("string"))
    percentage = F.lit(None).cast("double")
    for digits in sorted({3, *SUMMARY_DIGITS.values()}):
        own = [control for control, held in SUMMARY_DIGITS.items() if held == digits]
        applies = F.col("control_id").isin(own) if own else ~F.col("control_id").isin(list(SUMMARY_DIGITS))
        percentage = F.when(applies, share(F.col("total_deviations"), F.col("total_checked"), digits)).otherwise(percentage)
    return breakdown.select(
        RUN,
        "control_id",
        "control_name",
        "total_checked",
        "total_deviations",
        F.format_string("%.2f%%", half_even(percentage, 2)).alias("deviation_percentage"),
        F.when(suffix > 1, F.concat(sheet, F.lit("_"), suffix.cast("string"))).otherwise(sheet).alias("sheet"),
    )


# Sheets.


def _age_sheet(rides: DataFrame, control: int, date_column: str, routes: DataFrame | None) -> Detail:
    """Vehicles and a totals line below them."""
    vehicles = vehicles_by_age(rides, control, date_column)
    types = None if routes is None else vehicle_types(routes)
    lines = age_vehicles(vehicles, types).rows.withColumn("is_total", F.lit(False))
    totals = age_totals(vehicles).select(
        RUN, F.lit(TOTAL_LABEL).alias("kenteken"), "inzetdagen", F.col("passagiers").alias("vervoerde_passagiers"),
        F.lit(True).alias("is_total"),
    )
    return Detail(lines.unionByName(totals, allowMissingColumns=True), ["is_total", "kenteken"], hidden=("is_total",))


def _cost_sheet(key_figures: DataFrame) -> Detail:
    table = report_20_daily_table(key_figures)
    return replace(table, rows=table.rows.withColumn("kosten_rit", F.round("kosten_rit", COST_DIGITS)))


def control_sheet(details: Mapping[str, DataFrame], control: int, transport: str = "RG") -> tuple[Detail, list[str]]:
    """Rows of the sheet of one control, and its headers."""
    rides, routes, va_rides = details["ritten_detail"], details["routes_detail"], details["va_ritten_detail"]
    own: dict[int, tuple[Callable[[], Detail], dict[str, str]]] = {
        1: (lambda: report_1_detail(rides), REPORT_1_COLUMNS),
        5: (lambda: report_5_detail(routes), REPORT_5_COLUMNS),
        8: (lambda: report_8_detail(rides), REPORT_8_COLUMNS),
        10: (lambda: report_10_detail(routes, rides), {"route_key": "RouteKey", **REPORT_10_COLUMNS}),
        11: (lambda: report_11_vehicles(rides), REPORT_11_COLUMNS),
        13: (lambda: _age_sheet(rides, 13, "datum", routes), VEHICLE_AGE_COLUMNS),
        20: (lambda: _cost_sheet(details["kentallen_route"]), REPORT_20_COLUMNS),
        1004: (lambda: stacked_matrix(va_rides, 1004), {}),
        1005: (lambda: stacked_matrix(va_rides, 1005), {}),
        1006: (lambda: _age_sheet(va_rides, 1006, "rit_datum", None), VEHICLE_AGE_COLUMNS),
    }
    if control in own:
        build, headers = own[control]
        detail = build()
    else:
        detail = generic_detail(details[detail_dataset(control, transport)], control)
        headers = dict(zip(generic_fields(control), report_columns(control).values()))
    held = [name for name in detail.rows.columns if name not in (RUN, *detail.hidden)]
    return detail, [headers.get(name, headers.get(name.removesuffix("_s"), name)) for name in held]


def grouped_sheet(va_rides: DataFrame, control: int) -> tuple[Detail, list[str]]:
    """The list of vehicles of controls 1004 to 1006, and its headers."""
    detail = grouped_detail(va_rides, control)
    return detail, [GROUPED_COLUMNS[control][name] for name in detail.rows.columns if name != RUN]


def quoted(text: Column) -> Column:
    """A cell of a line: in quotes, doubled inside, where it holds a separator, a quote or a line break."""
    inside = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(f'[{SEPARATOR}"\\r\\n]'), inside).otherwise(text)


def _ranks(detail: Detail) -> list[Column]:
    """Sort keys of one type from the order of a report."""
    kinds = dict(detail.rows.dtypes)
    return [rank(kinds[name.lstrip("-")], F.col(name.lstrip("-")), name.startswith("-")) for name in detail.order]


def _line(names: Sequence[str], kinds: Mapping[str, str], value: Callable[[str], Column]) -> Column:
    return F.concat_ws(SEPARATOR, *[quoted(cell(name, kinds[name], value(name))) for name in names])


def _head(headers: Sequence[str]) -> Column:
    return F.concat_ws(SEPARATOR, *[quoted(F.lit(header)) for header in headers])


def sheet_lines(detail: Detail, headers: Sequence[str], control: int) -> DataFrame:
    """Lines of a sheet per run in report order (then by their text), numbered from 1; line 0 has the headers."""
    kinds = dict(detail.rows.dtypes)
    held = [name for name in detail.rows.columns if name not in (RUN, *detail.hidden)]
    lines = detail.rows.withColumn("_line", _line(held, kinds, F.col))
    unkept = [name for name in detail.rows.columns if name != RUN]
    rows = numbered(lines, [RUN], [*ordering(detail.order), F.col("_line").asc()], "row_no", unkept)
    heads = rows.where("row_no = 1").withColumns({"row_no": F.lit(0).cast("bigint"), "_line": _head(headers)})
    return rows.unionByName(heads).select(RUN, F.lit(control).alias("control_id"), "row_no", F.col("_line").alias("line"))


def _sheet_rows(detail: Detail, control: int, sheet: str) -> DataFrame:
    """(run, control_id, sheet, key, line) of a sheet."""
    kinds = dict(detail.rows.dtypes)
    held = [name for name in detail.rows.columns if name not in (RUN, *detail.hidden)]
    return detail.rows.select(
        RUN, F.lit(control).alias("control_id"), F.lit(sheet).alias("sheet"), F.array(*_ranks(detail)).alias("key"), _line(held, kinds, F.col).alias("line")
    )


def _with_heads(rows: DataFrame, headers: Mapping[str, Sequence[str]]) -> DataFrame:
    """(run, control_id, row_no, line) from rows of sheets: numbered in order, and line 0 for each."""
    lines = numbered(rows, [RUN, "control_id", "sheet"], [F.col("key").asc(), F.col("line").asc()], "row_no", unkept=["key"])
    head = F.element_at(F.create_map(*[part for sheet, names in headers.items() for part in (F.lit(sheet), _head(names))]), F.col("sheet"))
    heads = lines.where("row_no = 1").withColumns({"row_no": F.lit(0).cast("bigint"), "line": head})
    return lines.unionByName(heads).select(RUN, "control_id", "row_no", "line")


def _sheet_name(control: int, dataset: str) -> str:
    return f"{control}:{dataset}"


def _row_sheets(rows: DataFrame, dataset: str, controls: Sequence[int]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Sheets that list deviating rows of a dataset as they are, all from one pass over it, and their headers.

    Every row is formatted once, column by column, and gives one entry for each control that it deviates from.
    """
    own = {1: (report_1_parts, REPORT_1_COLUMNS), 5: (report_5_parts, REPORT_5_COLUMNS), 8: (report_8_parts, REPORT_8_COLUMNS)}
    parts, headers = {}, {}
    for control in controls:
        part = own[control][0](rows) if control in own else generic_parts(rows, control)
        rows, parts[control] = part.rows, part
        names = own[control][1] if control in own else dict(zip(generic_fields(control), report_columns(control).values()))
        kinds = dict(rows.select(*part.columns).dtypes)
        held = [name for name in kinds if name not in part.hidden]
        headers[_sheet_name(control, dataset)] = [names.get(name, names.get(name.removesuffix("_s"), name)) for name in held]
    labels: dict[str, str] = {}  # by the column's SQL: what several sheets show is formatted once
    cells: list[Column] = []
    each: list[Column] = []
    for control, part in parts.items():
        kinds = dict(rows.select(*part.columns).dtypes)
        shown = dict(zip(kinds, part.columns, strict=True))
        for name, column in shown.items():
            if name not in part.hidden and str(column) not in labels:
                labels[str(column)] = f"cell {len(labels)}"
                cells.append(quoted(cell(name, kinds[name], column)).alias(labels[str(column)]))
        keys = [rank(kinds[name.lstrip("-")], shown[name.lstrip("-")], name.startswith("-")) for name in part.order]
        cells += [part.condition.alias(f"if {control}"), F.array(*keys).alias(f"key {control}")]
        line = F.concat_ws(SEPARATOR, *[F.col(labels[str(column)]) for name, column in shown.items() if name not in part.hidden])
        named = F.lit(control).alias("control_id"), F.lit(_sheet_name(control, dataset)).alias("sheet")
        each.append(F.when(F.col(f"if {control}"), F.struct(*named, F.col(f"key {control}").alias("key"), line.alias("line"))))
    listed = rows.select(RUN, *cells).select(RUN, F.explode(F.array_compact(F.array(*each))).alias("entry"))
    return listed.select(RUN, "entry.*"), headers


def _of_rows(control: int) -> bool:
    """Whether the sheet of a control lists rows of its dataset."""
    return control in (1, 5, 8) or control not in GATHERED


#: Controls whose sheets are gathered from many rows.
GATHERED = (10, 11, 13, 20, 1004, 1005, 1006)


def export_bundle(details: Mapping[str, DataFrame], executed: DataFrame, controls: Sequence[int]) -> DataFrame:
    """(run, control_id, row_no, line) of the sheets of all controls, for the runs that executed them.

    ``executed`` holds run, control_id and soortvervoer; each sheet is read from its transport's dataset. Sheets that list
    rows take one pass over a dataset together. All lines are numbered at once.
    """
    datasets = {(control, transport): detail_dataset(control, transport) for control in controls for transport in TRANSPORTS}
    parts: list[DataFrame] = []
    headers: dict[str, Sequence[str]] = {}
    for dataset in dict.fromkeys(datasets.values()):
        own = [control for control in controls if dataset in (datasets[control, "RG"], datasets[control, "VA"])]
        listed = [control for control in own if _of_rows(control)]
        if listed:
            rows, heads = _row_sheets(details[dataset], dataset, listed)
            parts.append(rows)
            headers |= heads
        for control in (control for control in own if not _of_rows(control)):
            transport = next(transport for transport in TRANSPORTS if datasets[control, transport] == dataset)
            detail, heads = control_sheet(details, control, transport)
            sheet = _sheet_name(control, dataset)
            parts.append(_sheet_rows(detail, control, sheet))
            headers[sheet] = heads
    named = F.create_map(*[F.lit(part) for (control, transport), dataset in datasets.items() for part in (f"{control}:{transport}", _sheet_name(control, dataset))])
    wanted = executed.select(
        RUN, F.element_at(named, F.concat(F.col("control_id").cast("string"), F.lit(":"), transport_group(F.col("soortvervoer")))).alias("sheet")
    ).where("sheet is not null").distinct()
    return _with_heads(reduce(DataFrame.unionByName, parts).join(wanted, [RUN, "sheet"], "left_semi"), headers)


def write_csv(detail: Detail, headers: Sequence[str], path: str, run_id: int) -> None:
    """One CSV folder with the rows of one run: formatted cells under their headers, in report order."""
    chosen = replace(detail, rows=only_run(detail.rows, run_id))
    format_cells(chosen.sorted().drop(RUN)).toDF(*headers).write.option("header", True).mode("errorifexists").csv(path)


# Matrices.


def stacked_matrix(rides: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> Detail:
    """The three fleet tables of a control below each other, one line per cell."""
    weeks, trips, kilometres = STACKED_LABELS[control]
    kind, dimension, total, percentage = (name.lower() for name in STACKED_HEADERS)
    percent: Column = F.concat(plain_number(F.col("percentage")), F.lit("%"))
    tables = [
        fleet_weekly(rides, control, by).rows.select(
            *by, F.lit(weeks).alias(kind), F.col("iso_week").cast("string").alias(dimension),
            "category", F.col("vehicles").alias("cell"), F.col("total").cast("double").alias(total),
            F.lit("").alias(percentage),
        ),
        fleet_trips(rides, control, by).rows.select(
            *by, F.lit(trips).alias(kind), F.col("category").alias(dimension),
            F.col("trips").cast("double").alias(total), percent.alias(percentage),
        ),
        fleet_distance(rides, control, by).rows.select(
            *by, F.lit(kilometres).alias(kind), F.col("category").alias(dimension),
            F.col("distance").alias(total), percent.alias(percentage),
        ),
    ]
    stacked = reduce(lambda top, below: top.unionByName(below, allowMissingColumns=True), tables)
    place = F.array_position(F.array(*[F.lit(label) for label in sorted(STACKED_LABELS[control], reverse=True)]), F.col(kind))
    return Detail(stacked.withColumn("place", place), ["place", dimension, "category"], hidden=("place",))


# A wide matrix has a column for every category; more than this many are no report any more.
MOST_HEADS = 200


def categories(matrix: DataFrame, column: str) -> list[str]:
    """Column heads of a wide matrix: the distinct categories, sorted; refused if they are too many."""
    heads = [row[0] for row in matrix.select(column).distinct().limit(MOST_HEADS + 1).collect()]
    if len(heads) > MOST_HEADS:
        raise ValueError(f"more than {MOST_HEADS} different values of {column}")
    return sorted(heads)


def wide_matrix(
    matrix: DataFrame,
    keys: Sequence[str],
    column: str,
    values: Mapping[str, str],
    total: str = "total",
    heads: Sequence[str] | None = None,
) -> DataFrame:
    """A long matrix with one column per category and value, and the row total last.

    ``values`` maps a value column to the suffix of its wide columns. Give the ``heads`` where they are known;
    else a job looks them up first.
    """
    heads = categories(matrix, column) if heads is None else heads
    cells = [
        F.coalesce(F.max(F.when(F.col(column) == head, F.col(value))), F.lit(0)).alias(f"{head} {suffix}".strip())
        for head in heads
        for value, suffix in values.items()
    ]
    return matrix.groupBy(*keys).agg(*cells, F.max(total).alias(TOTAL_LABEL))


def fuel_matrix_wide(rides: DataFrame, period: str = "daily", by: Sequence[str] = PER_RUN) -> DataFrame:
    """Control 12 as exported: rides and percentage per fuel in columns."""
    matrix = (report_12_daily if period == "daily" else report_12_monthly)(rides, by).rows
    return wide_matrix(matrix, [*by, "period"], "fuel_type", {"rides": "aantal", "percentage": "%"})


def weekly_matrix_wide(rides: DataFrame, control: int, by: Sequence[str] = PER_RUN) -> DataFrame:
    """Controls 1004 and 1005 as exported: vehicles per category in columns."""
    matrix = fleet_weekly(rides, control, by).rows
    return wide_matrix(matrix, [*by, "iso_week"], "category", {"vehicles": ""})
