"""What the physical plans must look like on stored data."""

import pytest

from catalogue.adapter import Star
from catalogue.queries import GENERIC, details
from rideledger.operators.count import measure_controls, only_run
from rideledger.operators.unpivot import control_rows
from rideledger.plans.export import control_sheet, grouped_sheet
from rideledger.plans.rides import generic_detail, report_8_detail
from rideledger.sources.datasets import Store

COLUMNS = (
    "stuurtabel_id int, id bigint, datum date, vervoerder string, dempelwaarde_8 int, controlewaarde_8 int, resultaat_8 int, "
    "resultaat_9 int, tekst_9 string, geplande_instap_tijd_s int, geplande_uitstap_tijd_s int, klant_nummer bigint, "
    "reiziger_naam string, locatie_van string, locatie_naar string, gerealiseerde_instap_tijd_s int, gerealiseerde_uitstap_tijd_s int"
)


@pytest.fixture(scope="module")
def rides(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "rides")
    spark.createDataFrame([], COLUMNS).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_controls_take_one_scan_and_one_shuffle(rides):
    text = plan(measure_controls(rides, "ritten_detail"))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "reiziger_naam" not in text


def test_unpivot_does_not_shuffle(rides):
    text = plan(control_rows(rides, "rit"))
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_run_filter_reaches_the_scan_and_columns_are_pruned(rides):
    text = plan(generic_detail(only_run(rides, 7), 9).listing())
    assert "EqualTo(stuurtabel_id,7)" in text
    assert "dempelwaarde_8" not in text


def test_a_page_takes_the_top_rows_only(rides):
    assert "TakeOrderedAndProject" in plan(report_8_detail(rides).page(100, 200))


def test_current_reads_prune_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path), "demo")
    rows = spark.createDataFrame([(1, 10), (2, 20)], "stuurtabel_id int, id int")
    store.write_version("ritten_detail", rows, "1")
    found = store.read_current("ritten_detail", {2: {"ritten_detail": "1"}})
    assert [row.id for row in found.collect()] == [20]
    assert found.inputFiles() and all("stuurtabel_id=2" in file for file in found.inputFiles())


def test_every_sheet_has_a_header_per_column(spark):
    star = Star(spark, "/root/testdata/sf0.001")
    frames = details(star)
    for control in [1, 5, 8, 10, 11, 13, 20, 1004, 1005, 1006, *GENERIC]:
        detail, headers = control_sheet(frames, control, "VA" if control > 1000 else "RG")
        assert len(headers) == len(detail.listing().columns) - 1
        assert not any(header.endswith("_s") for header in headers)
    for control in (1004, 1005, 1006):
        detail, headers = grouped_sheet(frames["va_ritten_detail"], control)
        assert headers[0] == "Kenteken" and len(headers) == len(detail.listing().columns) - 1


def test_unpivot_makes_its_array_once_before_the_generator(rides):
    """In a projection it is compiled; a filter on its size would make it a second time."""
    text = plan(control_rows(rides, "rit"))
    assert "Generate inline(_controls#" in text and "size(" not in text
