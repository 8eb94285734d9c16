from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from catalogue.queries import SHEETS
from rideledger.operators.count import measure_controls, only_run, summary
from rideledger.functions.predicates import nonzero
from rideledger.operators.detail import Detail, numbered, sorted_rows
from rideledger.operators.matrix import zero_filled
from rideledger.operators.unpivot import control_rows
from rideledger.plans.dashboard import deviations_per_carrier
from rideledger.plans.export import _row_sheets, export_bundle, sheet_lines


def test_unpivot_keeps_results_and_texts(spark):
    df = spark.createDataFrame(
        [(1, 10, 0, None, 1, "x"), (1, 11, None, "alleen tekst", None, "x"), (1, 12, None, None, 2, "x")],
        "stuurtabel_id int, id int, resultaat_1 int, tekst_1 string, resultaat_19 int, tekst_99 string",
    )
    rows = {(row.entity_id, row.controle_id): (row.resultaat, row.tekst, row.is_deviation) for row in control_rows(df, "rit").collect()}
    assert rows == {
        (10, 1): ("0", None, False),
        (10, 19): ("1", None, True),
        (11, 1): (None, "alleen tekst", False),
        (12, 19): ("2", None, True),
    }


def test_unpivot_of_text_results_reads_words(spark):
    df = spark.createDataFrame([(1, 1, "Niet ok"), (1, 2, "ok"), (1, 3, "2")], "stuurtabel_id int, id int, resultaat_3 string")
    assert {row.entity_id: row.is_deviation for row in control_rows(df, "rit").collect()} == {1: True, 2: False, 3: True}


def test_unpivot_without_controls_is_empty(spark):
    assert control_rows(spark.createDataFrame([(1,)], "id int"), "rit").count() == 0


def test_pages_add_up_to_the_sorted_listing(spark):
    df = spark.createDataFrame([(i % 5, i % 3, i) for i in range(53)] + [(None, 1, 99)], "a int, b int, c int")
    detail = Detail(df, ["-a", "b"])
    pages = [row for offset in range(0, 60, 10) for row in detail.page(10, offset).collect()]
    assert pages == detail.sorted().collect()
    assert pages[-1].a is None


def test_zero_filled_matrix(spark):
    cells = spark.createDataFrame([(1, "a", "x", 2), (1, "b", "y", 3), (2, "a", "x", 1)], "run int, row string, col string, n bigint")
    got = {(r.run, r.row, r.col): (r.n, r.total) for r in zero_filled(cells, ["run"], "row", "col", "n", "total").collect()}
    assert got == {(1, "a", "x"): (2, 2), (1, "a", "y"): (0, 2), (1, "b", "x"): (0, 3), (1, "b", "y"): (3, 3), (2, "a", "x"): (1, 1)}
    pooled = zero_filled(cells.where("run = 1"), [], "row", "col", "n", "total")
    assert pooled.count() == 4


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "stuurtabel_id int, resultaat_1 int")
    assert tuple(summary(empty, F.lit(True), by=()).first()) == (0, 0, 0.0)
    assert summary(empty, F.lit(True)).count() == 0


def test_only_run(spark):
    df = spark.createDataFrame([(1,), (2,)], "stuurtabel_id int")
    assert only_run(df, 2).count() == 1 and only_run(df, None).count() == 2


@pytest.mark.parametrize("column, expected", [("resultaat_9 int", [(9, 2, 1)]), ("niets int", []), ("tekst_9 string", [(9, 2, 1)])])
def test_measures_follow_the_columns_there_are(spark, column, expected):
    value = {"string": "te laat"}.get(column.split()[1], 1)
    df = spark.createDataFrame([(1, value), (1, None)], f"stuurtabel_id int, {column}")
    got = measure_controls(df, "ritten_detail").collect()
    assert [(row.control_id, row.total_checked, row.total_deviations) for row in got] == expected


def test_text_results_are_tolerated(spark):
    df = spark.createDataFrame([(1, "1"), (1, "n.v.t."), (1, "0")], "stuurtabel_id int, resultaat_9 string")
    assert measure_controls(df, "ritten_detail").first().total_deviations == 1


def test_total_of_pages(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "stuurtabel_id int, v string")
    assert {tuple(row) for row in Detail(df, ["v"]).total().collect()} == {(1, 2), (2, 1)}
    assert Detail(df, ["v"]).total(by=()).first().total_rows == 3


def test_sorted_by_several_displayed_columns(spark):
    shown = ["10-01-2024", "", "2,5%", "1.000", "9:05", "10:00", "b", "A", None, "2023-12-31", "b"]
    df = spark.createDataFrame([(i, text, str(i % 2)) for i, text in enumerate(shown)], "i int, t string, u string")
    up = [row.t for row in sorted_rows(df, [("t", True)], "i").orderBy("place").collect()]
    assert up == ["", None, "2023-12-31", "10-01-2024", "9:05", "10:00", "2,5%", "1.000", "A", "b", "b"]
    down = [(row.t, row.i) for row in sorted_rows(df, [("t", False)], "i").orderBy("place").collect()]
    assert [text for text, _ in down] == ["b", "b", "A", "1.000", "2,5%", "10:00", "9:05", "10-01-2024", "2023-12-31", "", None]
    assert down[:2] == [("b", 6), ("b", 10)]  # alike: in the order they stood in
    both = [row.i for row in sorted_rows(df, [("u", False), ("t", True)], "i").orderBy("place").collect()]
    assert both[:5] == [1, 9, 5, 3, 7] and len(both) == len(shown)


def test_nan_is_no_deviation(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (2.0,), (None,)], "resultaat_9 double")
    assert [row.d for row in df.select(nonzero(df, "resultaat_9").alias("d")).collect()] == [False, False, True, False]
    rows = control_rows(df, "rit").collect()
    assert sorted((row.resultaat, row.is_deviation) for row in rows) == [("0.0", False), ("2.0", True)]


def test_lines_are_quoted_numbered_and_headed(spark):
    df = spark.createDataFrame([(1, "a;b", 'say "x"'), (1, "c", "d"), (2, "line\nbreak", None)], "stuurtabel_id int, v string, w string")
    lines = {(row.stuurtabel_id, row.row_no): row.line for row in sheet_lines(Detail(df, ["-v"]), ["V", "W;X"], 9).collect()}
    assert lines == {
        (1, 0): 'V;"W;X"', (1, 1): "c;d", (1, 2): '"a;b";"say ""x"""', (2, 0): 'V;"W;X"', (2, 1): '"line\nbreak";'
    }


def test_sheets_come_from_the_dataset_of_the_runs_transport(spark):
    kinds = "stuurtabel_id int, id int, resultaat_2 int, tekst_2 string, resultaat_1001 int, tekst_1001 string"
    details = {
        "ritten_detail": spark.createDataFrame([(1, 10, 1, "rg", 0, None), (2, 11, 1, "lost", 0, None)], kinds),
        "va_ritten_detail": spark.createDataFrame([(2, 20, 1, "va", 1, "va"), (1, 21, 1, "lost", 1, "lost")], kinds),
        "routes_detail": spark.createDataFrame([], kinds),
    }
    executed = spark.createDataFrame([(1, 2, "RG"), (2, 2, " va "), (2, 1001, "VA")], "stuurtabel_id int, control_id int, soortvervoer string")
    got = export_bundle(details, executed, [2, 1001]).where("row_no > 0").collect()
    assert sorted((row.stuurtabel_id, row.control_id, row.line.split(";")[-1]) for row in got) == [(1, 2, "rg"), (2, 2, "va"), (2, 1001, "va")]


def test_cost_sheet_is_registered_and_has_rounded_means(spark):
    assert 20 in SHEETS
    none = spark.createDataFrame([], "stuurtabel_id int, id int")
    costs = spark.createDataFrame(
        [(1, "1997-05-01", "0.1", "1"), (1, "1997-05-01", "0.2", "2"), (1, "1997-05-02", "n.v.t.", "4")],
        "stuurtabel_id int, datum string, kosten_rit string, n_ritten string",
    )
    details = {"ritten_detail": none, "va_ritten_detail": none, "routes_detail": none, "kentallen_route": costs}
    executed = spark.createDataFrame([(1, 20, "RG")], "stuurtabel_id int, control_id int, soortvervoer string")
    lines = [row.line for row in export_bundle(details, executed, [20]).orderBy("row_no").collect()]
    assert len(lines[0].split(";")) == 3 and lines[1:] == ["01-05-1997;3;0.166666667", "02-05-1997;4;"]


def test_deviations_per_carrier_tell_rides_of_both_kinds_apart(spark):
    shape = "stuurtabel_id int, id int, vervoerder string, resultaat_2 int"
    rides = spark.createDataFrame([(1, 7, "a", 1), (1, 8, "a", 0)], shape)
    va_rides = spark.createDataFrame([(1, 7, "a", 1), (2, 7, "b", 1)], shape)
    long = control_rows(rides, "rit").unionByName(control_rows(va_rides, "va_rit"))
    assert sorted(map(tuple, deviations_per_carrier(long).collect())) == [(1, "a", 2), (2, "b", 1)]


def test_numbering_of_one_hot_group_is_spread(spark):
    """One run has nearly all rows: numbers are those of a plain sort, and no task has more than twice the median."""
    hot = spark.range(40_000).selectExpr("case when id % 1000 = 0 then null when id % 500 = 1 then 2 else 1 end as run", "id * 7919 % 40000 as v", "id")
    rows = numbered(hot.repartition(7), ["run"], [F.col("v").desc()], "place")
    got = {}
    for row in rows.select("run", "v", "place").collect():
        got.setdefault(row.run, []).append((row.place, row.v))
    for held in got.values():
        held.sort()
        assert [place for place, _ in held] == list(range(1, len(held) + 1))
        assert [v for _, v in held] == sorted((v for _, v in held), reverse=True)
    assert sorted(map(len, got.values())) == [40, 80, 39_880]
    spread = hot.repartitionByRange(8, F.col("run").asc(), F.col("v").desc()).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert spread.max() <= 2 * spread.median()


def test_listing_sheets_share_one_scan(spark, tmp_path):
    """Sheets that list rows of a dataset read it once, whatever their number."""
    columns = "stuurtabel_id int, datum date, vervoerder string, klant_nummer bigint, " + ", ".join(f"resultaat_{c} int, tekst_{c} string" for c in (2, 9, 12, 16))
    path = str(tmp_path / "rides")
    values = [(1, None, f"v{i % 3}", i, *[x for c in range(4) for x in (int(i % (c + 2) == 0), f"t{c}")]) for i in range(30)]
    spark.createDataFrame(values, columns).write.parquet(path)
    rows, headers = _row_sheets(spark.read.parquet(path), "ritten_detail", [2, 9, 12, 16])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and len(headers) == 4
    assert {row.control_id: row["count"] for row in rows.groupBy("control_id").count().collect()} == dict.fromkeys((2, 9, 12, 16), 30)


def test_numbering_keeps_rows_once_and_moves_them_once(spark):
    """Only what is returned is written, in columns; the numbered rows are not shuffled to meet the counts of their ranges."""
    rows = spark.range(1000).selectExpr("id % 3 as run", "concat('line ', cast(id as string)) as line", "-id as place", "null as nothing")
    out = numbered(rows.repartition(5), ["run"], [F.col("place").asc()], "row_no", unkept=["place"])
    assert out.columns == ["run", "line", "nothing", "row_no"]
    assert sorted((r.run, r.row_no, r.line) for r in out.collect()) == sorted(
        (run, no + 1, f"line {i}") for run in range(3) for no, i in enumerate(sorted(range(run, 1000, 3), reverse=True))
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Scan ExistingRDD" not in plan
    stored = [path for path in out.inputFiles() if "/rows/" in path]
    assert stored and spark.read.parquet(*stored).columns == ["run", "line", "_at"]
