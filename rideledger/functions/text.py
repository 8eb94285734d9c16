"""Texts: trimming, location codes, cell formatting, sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.fixed_values import (
    CLOCK_COLUMNS,
    CLOCK_TEXT,
    DATE_FORMAT,
    DATE_TEXT,
    DEVIATION_WORDS,
    DUTCH_DATE_TEXT,
    LOCATION_CODE,
    PLAIN_NUMBER_TEXT,
    TIME_FORMAT,
    TIME_NAME_ENDS,
    TIME_NAME_PART,
    TIME_NAME_START,
    TIMESTAMP_FORMAT,
    TIMESTAMP_TEXT,
    TRUTHY,
    WHITE_SPACE,
)
from rideledger.functions.numeric import number


def strip(text: Column) -> Column:
    """Trim every kind of white space, not just spaces."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_location_code(text: Column) -> Column:
    """Location without its leading five-digit code; NULL becomes empty."""
    return F.regexp_replace(strip(F.coalesce(text.cast("string"), F.lit(""))), LOCATION_CODE, "")


def truthy(value: Column) -> Column:
    """Whether a done flag of any type means yes; a numeric one counts however it is written."""
    text = F.lower(strip(value.cast("string")))
    return F.coalesce(text.isin(TRUTHY) | (number(text) == 1), F.lit(False))


def deviation_flag(result: Column) -> Column:
    """Whether a result text reports a deviation: by its words, or by a number other than zero.

    A whole number in its usual form needs no patterns; it has no words either.
    """
    says_so = F.lower(result).rlike(DEVIATION_WORDS)
    value = number(result)
    nonzero = ~F.isnan(value) & (value != 0)
    text = result.cast("string")
    whole = text.try_cast("bigint")
    return F.when(whole.cast("string") == text, whole != 0).otherwise(F.coalesce(says_so, F.lit(False)) | F.coalesce(nonzero, F.lit(False)))


def clock(seconds: Column) -> Column:
    """Seconds since midnight as ``HH:mm``."""
    shown = F.format_string("%02d:%02d", F.floor(seconds / 3600), F.pmod(F.floor(seconds / 60), F.lit(60)))
    return F.when(seconds.isNotNull(), shown)


def minutes_label(minutes: Column) -> Column:
    """A duration as ``1u 05m``, ``12 min`` or ``n.v.t.``"""
    hours = F.floor(minutes / 60)
    rest = F.pmod(minutes.cast("bigint"), F.lit(60).cast("bigint"))
    return (
        F.when(minutes.isNull(), F.lit("n.v.t."))
        .when(hours != 0, F.format_string("%du %02dm", hours, rest))
        .otherwise(F.format_string("%d min", rest))
    )


def is_time_like(name: str) -> bool:
    return TIME_NAME_PART in name or name.startswith(TIME_NAME_START) or name.endswith(TIME_NAME_ENDS)


def plain_number(value: Column) -> Column:
    """A double as text without an exponent, with at least one decimal."""
    size = F.abs(value)
    digits = F.regexp_replace(value.try_cast("decimal(38,10)").cast("string"), r"0+$", "")
    spelled = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    is_plain = (size == 0) | ((size >= 1e-3) & (size < 1e7))
    return F.when(is_plain, value.cast("string")).otherwise(F.coalesce(spelled, value.cast("string")))


def cell(name: str, kind: str, value: Column) -> Column:
    """One exported cell as text, formatted by column name and type; NULL becomes empty."""
    if name.endswith("_s") and is_time_like(name[:-2]):
        shown = clock(value)
    elif kind == "date":
        shown = F.date_format(value, DATE_FORMAT if name in ("datum", "rit_datum", "route_date") else "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        shown = F.date_format(value, DATE_FORMAT if name == "datum" else TIMESTAMP_FORMAT)
    elif kind == "string":
        shown = _text_cell(name, value)
    elif kind in ("double", "float"):
        shown = plain_number(value)
    else:
        shown = value.cast("string")
        if is_time_like(name):
            shown = F.substring(shown, 1, 5)
    return F.coalesce(shown, F.lit(""))


def _text_cell(name: str, value: Column) -> Column:
    text = strip(value)
    stamp = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    day = F.when(text.rlike(DATE_TEXT), F.try_to_date(text, "yyyy-MM-dd"))
    shape = DATE_FORMAT if name == "datum" else TIME_FORMAT if name in CLOCK_COLUMNS else TIMESTAMP_FORMAT
    rest = F.substring(value, 1, 5) if is_time_like(name) else value
    return F.coalesce(
        F.when(text.rlike(TIMESTAMP_TEXT), F.date_format(stamp, shape)),
        F.date_format(day, DATE_FORMAT),
        rest,
    )


# Order of the kinds a sorted text can be; blanks come before all of them.
KINDS = ["empty", "date", "time", "number", "text"]


def sort_key(text: Column) -> Column:
    """Sort key of a displayed text: blank, date, time, Dutch number or plain text.

    Ascending order puts blanks first, descending order puts them last. Keys of one
    kind compare by value; a column that mixes kinds is ordered by kind first.
    """
    value = F.coalesce(strip(text), F.lit(""))
    day = F.regexp_extract(value, DUTCH_DATE_TEXT, 0)
    turned = F.regexp_replace(value, DUTCH_DATE_TEXT, "$3-$2-$1")
    dutch = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\.", ""), "^([^,]*),", "$1."), "^([^%]*)%", "$1")
    kind = (
        F.when(value == "", 0)
        .when((day != "") | value.rlike(DATE_TEXT), 1)
        .when(value.rlike(CLOCK_TEXT), 2)
        .when(dutch.rlike(PLAIN_NUMBER_TEXT), 3)
        .otherwise(4)
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == 3, dutch.try_cast("double")).alias("number"),
        F.when(kind == 1, turned).when(kind == 2, F.lpad(value, 5, "0")).when(kind == 4, F.lower(value)).alias("text"),
    )


def as_text(df: DataFrame, name: str) -> Column:
    """A value of any type as text, NULL and NaN as NULL; NULL where the column is absent."""
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(None).cast("string")
    if kind in ("double", "float"):
        return F.when(~F.isnan(name), plain_number(F.col(name)))
    return F.col(name).cast("string")


def as_label(df: DataFrame, name: str) -> Column:
    """A number that names something, as text: whole ones without a fraction."""
    if dict(df.dtypes)[name] in ("double", "float"):
        whole = F.col(name).try_cast("bigint")
        return F.coalesce(F.when(whole == F.col(name), whole.cast("string")), as_text(df, name))
    return as_text(df, name)
