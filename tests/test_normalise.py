from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from rideledger.operators.normalise import (
    coerce_types,
    current_runs,
    join_executed_controls,
    of_runs,
    prepare,
    prepare_executed_controls,
    promote_text_columns,
    resolve_aliases,
    run_column,
    snake_case,
    snake_case_columns,
    times_to_seconds,
    with_run_id,
)

NOW = datetime(2024, 1, 2, tzinfo=UTC)


@pytest.mark.parametrize(
    "given, expected",
    [("KlantNummer", "klant_nummer"), ("BedragExBTW", "bedrag_ex_btw"), ("Resultaat_1", "resultaat_1"),
     ("Resultaat1", "resultaat1"), (" Datum (rit) ", "datum_rit")],
)
def test_snake_case(given, expected):
    assert snake_case(given) == expected


def test_colliding_names_are_refused(spark):
    with pytest.raises(ValueError, match="a_b"):
        snake_case_columns(spark.createDataFrame([(1, 2)], "A_b int, aB int"))


def test_run_id_column_and_filter(spark):
    df = spark.createDataFrame([("7", 1), ("x", 2), ("8.0", 3)], "StuurtabelId string, id int")
    rows = with_run_id(snake_case_columns(df))
    assert [row.stuurtabel_id for row in rows.orderBy("id").collect()] == [7, None, 8]
    assert [row.id for row in of_runs(rows, [8]).collect()] == [3]
    assert of_runs(rows, []).count() == 0
    with pytest.raises(ValueError):
        run_column(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError):
        of_runs(spark.createDataFrame([(1,)], "x int"), [1])


def test_current_runs_are_distinct_and_numeric(spark):
    df = spark.createDataFrame([("5", "a"), ("5", "a"), ("?", "b")], "StuurtabelId string, Omschrijving string")
    assert [tuple(row) for row in current_runs(df).collect()] == [(5, "a", None)]


def test_first_alias_wins(spark):
    df = spark.createDataFrame([("a", "b", 1)], "controle_code string, control_code string, done int")
    row = resolve_aliases(df, ["controlecode", "uitgevoerd", "timestamp"]).first()
    assert row.controlecode == "a" and row.uitgevoerd == 1 and "timestamp" not in row


def test_coerce_types(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "12", "3.5"), ("2024-01-05T10:00:00", "12.0", "x"), ("nooit", "12.5", None)],
        "datum string, id string, bedrag_ex_btw string",
    )
    rows = [tuple(row) for row in coerce_types(df, ["datum"], ["id", "bedrag_ex_btw"]).collect()]
    assert rows == [(date(2024, 1, 5), 12, 3.5), (date(2024, 1, 5), 12, None), (None, None, None)]


def test_times_become_seconds(spark):
    df = spark.createDataFrame(
        [("08:15:30", datetime(1900, 1, 1, 9, 0)), ("8:15", None), ("geen", None), (None, None)],
        "netto_instap string, geplande_uitstap timestamp_ntz",
    )
    rows = [tuple(row) for row in times_to_seconds(df).select("netto_instap_s", "geplande_uitstap_s").collect()]
    assert rows == [(29730, 32400), (29700, None), (None, None), (None, None)]


def test_prepare_keeps_only_asked_runs(spark):
    df = spark.createDataFrame([(1, "10"), (2, "11")], "StuurtabelId int, Id string")
    rows = prepare("ritten_detail", df, "demo", [2], NOW)
    assert [(row.stuurtabel_id, row.id, row.client_slug) for row in rows.collect()] == [(2, 11, "demo")]
    assert prepare("ritten_detail", df, "demo", [], NOW).count() == 0
    with pytest.raises(ValueError):
        prepare("ritten_detail", spark.createDataFrame([(1,)], "Id int"), "demo", [1], NOW)


def test_prepare_executed_controls_defaults(spark):
    df = spark.createDataFrame([(1, 8)], "stuurtabel_id int, controle_id int")
    row = prepare_executed_controls(df, "demo", [1], NOW).first()
    assert (row.controlecode, row.uitgevoerd, row.timestamp, row.omschrijving) == (8, True, None, None)


def test_executed_controls_join(spark):
    done = spark.createDataFrame([(1, 8, "eigen"), (1, None, "leeg"), (1, 99, "los")], "StuurtabelId int, ControleId int, Omschrijving string")
    catalog = spark.createDataFrame([(8, "reistijd"), (None, "zonder")], "ControleId int, Omschrijving string")
    joined = join_executed_controls(done, catalog)
    found = {row.omschrijving_done: row.omschrijving for row in joined.collect()}
    assert found == {"eigen": "reistijd", "leeg": "zonder", "los": None}
    alone = join_executed_controls(done, catalog.limit(0))
    assert alone.columns == joined.columns
    assert {row.omschrijving_done: row.omschrijving for row in alone.collect()} == {"eigen": "eigen", "leeg": "leeg", "los": "los"}
    assert join_executed_controls(done.limit(0), catalog).count() == 0


def test_row_ids_are_never_join_keys(spark):
    done = spark.createDataFrame([(500, 1, 8)], "id int, stuurtabel_id int, controle_id int")
    catalog = spark.createDataFrame([(3, 8, "reistijd")], "id int, controle_id int, omschrijving string")
    assert join_executed_controls(done, catalog).first().omschrijving == "reistijd"


def test_promote_text_columns(spark):
    df = spark.createDataFrame([("1", "1.5", "1", None, "a"), ("2", "2", "x", None, None)], "i string, d string, m string, e string, t string")
    assert dict(promote_text_columns(df).dtypes) == {"i": "bigint", "d": "double", "m": "string", "e": "string", "t": "string"}
    assert promote_text_columns(df.select(F.lit(1).alias("n"))).dtypes == [("n", "int")]
