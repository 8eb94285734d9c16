"""Source rows to dataset rows: names, metadata, aliases, types, joined controls."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.fixed_values import (
    ALIASES,
    DATE_COLUMNS,
    DATE_TEXT,
    NOT_IN_NAMES,
    NUMBER_COLUMNS,
    RUN_ID_NAMES,
    TIME_AT_END,
    TIME_COLUMNS,
    WORD_BREAK,
)
from rideledger.functions.numeric import number
from rideledger.functions.text import as_text, truthy
from rideledger.registry import RUN

# Numbers that may have a fraction; the others identify something and are whole.
AMOUNTS = ("bedrag_ex_btw", "perceel")


def snake_case(name: str) -> str:
    """``BedragExBTW`` to ``bedrag_ex_btw``; digits are not split off from letters before them."""
    split = re.sub(WORD_BREAK, r"\1_\2", name)
    return re.sub(NOT_IN_NAMES, "_", split).strip("_").lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    names = [snake_case(name) for name in df.columns]
    twice = sorted({name for name in names if names.count(name) > 1})
    if twice:
        raise ValueError(f"columns with the same normalised name: {', '.join(twice)}")
    return df.toDF(*names)


def run_column(df: DataFrame) -> str:
    """The column that holds the run id."""
    for name in RUN_ID_NAMES:
        if name in df.columns:
            return name
    raise ValueError("no run id column among: " + ", ".join(df.columns))


def _is_integral(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint")


def whole_number(df: DataFrame, name: str) -> Column:
    """Column as a whole number; what is none becomes NULL."""
    if _is_integral(df, name):
        return F.col(name).cast("bigint")
    text = F.col(name).cast("string")
    value = number(text)
    rounded = F.when(value == F.floor(value), value).try_cast("bigint")
    return F.coalesce(text.try_cast("bigint"), rounded)


def with_run_id(df: DataFrame) -> DataFrame:
    """Run id as a whole number under its own name."""
    return df.withColumn(RUN, whole_number(df, run_column(df)))


def of_runs(df: DataFrame, run_ids: list[int]) -> DataFrame:
    """Rows of the given runs; without runs, no rows. Pushed down to the source."""
    if RUN not in df.columns:
        raise ValueError(f"no {RUN} column among: " + ", ".join(df.columns))
    return df.where(F.col(RUN).isin([int(run) for run in run_ids])) if run_ids else df.where(F.lit(False))


def current_runs(source: DataFrame) -> DataFrame:
    """Distinct runs of the run table with description and transport."""
    named = snake_case_columns(source)
    texts = [
        (F.col(name) if name in named.columns else F.lit(None)).cast("string").alias(name)
        for name in ("omschrijving", "soortvervoer")
    ]
    return with_run_id(named).where(F.col(RUN).isNotNull()).select(RUN, *texts).distinct()


def with_sync_metadata(df: DataFrame, client: str, synced_at: datetime | Column) -> DataFrame:
    """Normalised names, client, time of the sync and a numeric run id."""
    stamp = synced_at if isinstance(synced_at, Column) else F.lit(synced_at)
    named = snake_case_columns(df).withColumns({"client_slug": F.lit(client), "synced_at": stamp.cast("timestamp")})
    return named.withColumn(RUN, whole_number(named, RUN)) if RUN in named.columns else named


def resolve_aliases(df: DataFrame, canonical: list[str]) -> DataFrame:
    """Add each missing canonical column from the first of its aliases that exists."""
    for name in canonical:
        alias = next((alias for alias in ALIASES.get(name, []) if alias in df.columns), None)
        if name not in df.columns and alias:
            df = df.withColumn(name, F.col(alias))
    return df


def _as_date(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "string":
        return F.try_to_timestamp(F.trim(F.col(name))).cast("date")
    return F.col(name).cast("date")


def coerce_types(df: DataFrame, dates: list[str], numbers: list[str]) -> DataFrame:
    """Dates and numbers where they parse, NULL where not; the done flag as a boolean."""
    changed: dict[str, Column] = {name: _as_date(df, name) for name in dates if name in df.columns}
    for name in numbers:
        if name in df.columns:
            changed[name] = number(F.col(name)) if name in AMOUNTS else whole_number(df, name)
    if "uitgevoerd" in df.columns:
        changed["uitgevoerd"] = truthy(F.col("uitgevoerd"))
    return df.withColumns(changed) if changed else df


def _seconds(df: DataFrame, name: str) -> Column:
    text = F.regexp_extract(F.col(name).cast("string"), TIME_AT_END, 0)
    parts = F.split(F.split(text, r"\.")[0], ":")
    second = F.coalesce(F.get(parts, F.lit(2)).try_cast("int"), F.lit(0))
    return F.when(text != "", parts[0].try_cast("int") * 3600 + F.get(parts, F.lit(1)).try_cast("int") * 60 + second)


def times_to_seconds(df: DataFrame) -> DataFrame:
    """Times of day (times, timestamps or ``HH:mm[:ss]`` texts) as seconds since midnight, named ``<column>_s``."""
    times = [name for name in TIME_COLUMNS if name in df.columns and not _is_integral(df, name)]
    return df.withColumns({f"{name}_s": _seconds(df, name) for name in times}).drop(*times) if times else df


def prepare(dataset: str, df: DataFrame, client: str, run_ids: list[int], synced_at: datetime | Column) -> DataFrame:
    """Dataset rows of the given runs from source rows of a detail table."""
    rows = of_runs(with_sync_metadata(df, client, synced_at), run_ids)
    return times_to_seconds(coerce_types(rows, DATE_COLUMNS.get(dataset, []), NUMBER_COLUMNS[dataset]))


def prepare_executed_controls(
    df: DataFrame, client: str, run_ids: list[int], synced_at: datetime | Column
) -> DataFrame:
    """Executed controls of the given runs; a missing done flag means done."""
    rows = resolve_aliases(
        with_sync_metadata(df, client, synced_at), [RUN, "controlecode", "uitgevoerd", "timestamp", "omschrijving"]
    )
    defaults = {
        "controlecode": F.col("controle_id") if "controle_id" in rows.columns else F.lit(None).cast("bigint"),
        "uitgevoerd": F.lit(True),
        "timestamp": F.lit(None).cast("timestamp"),
        "omschrijving": F.lit(None).cast("string"),
    }
    rows = rows.withColumns({name: value for name, value in defaults.items() if name not in rows.columns})
    if RUN in rows.columns:
        rows = rows.withColumn(RUN, whole_number(rows, RUN))
    typed = coerce_types(of_runs(rows, run_ids), [], NUMBER_COLUMNS["executed_controls"])
    if dict(typed.dtypes)["timestamp"] == "string":
        typed = typed.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return typed


def _with_control_id(df: DataFrame) -> DataFrame:
    named = next((name for name in ("controle_id", "id", "controlecode") if name in df.columns), None)
    return df.withColumn("controle_id", F.col(named)) if named else df


def join_executed_controls(done: DataFrame, catalog: DataFrame) -> DataFrame:
    """Executed controls with what the control catalog says about them.

    Joined on control and run, never on a bare row id; NULL keys match. Other columns
    both sides have are kept as ``_done`` and ``_controle``; the description is the
    catalog's. With an empty catalog rows keep their own; whether it is empty shows when the rows are
    computed, not before.
    """
    left = _with_control_id(snake_case_columns(done))
    right = _with_control_id(snake_case_columns(catalog))
    keys = [name for name in (RUN, "controle_id", "controlecode") if name in left.columns and name in right.columns]
    if not keys:
        return left
    both = [name for name in left.columns if name in right.columns and name not in keys]
    left = left.withColumnsRenamed({name: f"{name}_done" for name in both})
    right = right.withColumnsRenamed({**{name: f"{name}_controle" for name in both}, **{key: f"_{key}" for key in keys}})
    matched = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    joined = left.join(right, matched, "left").drop(*[f"_{key}" for key in keys])
    if "omschrijving" in both:
        entries = catalog.agg(F.count("*")).scalar()
        described = F.when(entries > 0, F.col("omschrijving_controle")).otherwise(F.col("omschrijving_done"))
        joined = joined.withColumn("omschrijving", described)
    return joined


def promote_text_columns(df: DataFrame) -> DataFrame:
    """Text columns that hold only dates or only numbers get that type: dates, whole numbers or doubles.

    One aggregation over all text columns decides; columns without any value stay text.
    """
    texts = [name for name, kind in df.dtypes if kind == "string"]
    if not texts:
        return df
    checks = [
        check.alias(f"{kind}_{position}")
        for position, name in enumerate(texts)
        for kind, check in (
            ("values", F.count(name)),
            ("numbers", F.count(number(F.col(name)))),
            ("wholes", F.count(F.trim(name).try_cast("bigint"))),
            ("dates", F.count(F.when(F.trim(name).rlike(DATE_TEXT), F.trim(name).try_cast("date")))),
        )
    ]
    found = df.agg(*checks).first()
    promoted = {}
    for position, name in enumerate(texts):
        values = found[f"values_{position}"]
        if values and found[f"dates_{position}"] == values:
            promoted[name] = F.trim(name).cast("date")
        elif values and found[f"wholes_{position}"] == values:
            promoted[name] = F.trim(name).cast("bigint")
        elif values and found[f"numbers_{position}"] == values:
            promoted[name] = number(F.col(name))
    return df.withColumns(promoted) if promoted else df


def united(top: DataFrame, below: DataFrame) -> DataFrame:
    """Rows of both, columns matched by name; a column that is a text on one side is one on both."""
    kinds = dict(top.dtypes), dict(below.dtypes)
    texts = {name for name in kinds[0].keys() & kinds[1].keys() if kinds[0][name] != kinds[1][name] and "string" in (kinds[0][name], kinds[1][name])}
    parts = [df.withColumns({name: as_text(df, name) for name in sorted(texts)}) if texts else df for df in (top, below)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)
