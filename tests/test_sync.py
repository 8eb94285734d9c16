from datetime import UTC, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rideledger.plans import measures, sync
from rideledger.plans.dashboard import control_trend, dashboard_metrics, entity_counts
from rideledger.plans.export import write_csv
from rideledger.operators.detail import Detail
from rideledger.sources.datasets import Store, shared_folder
from rideledger.sources.tables import parquet_reader, table_name

DAY = datetime(2024, 5, 1, tzinfo=UTC)


def source(spark, runs):
    """A source system with two rides per run; even runs are on demand."""
    listed = spark.createDataFrame([(run, f"run {run}", " va " if run % 2 == 0 else "RG") for run in runs], "StuurtabelId int, Omschrijving string, SoortVervoer string")
    every = [run for run in range(1, 9)]
    rides = spark.createDataFrame([(run, run * 10 + n, n, "fout" if n else None) for run in every for n in (0, 1)], "StuurtabelId int, Id int, Resultaat_1 int, Tekst_1 string")
    routes = spark.createDataFrame([(run, run, 0) for run in every], "StuurtabelId int, Id int, Resultaat_3 int")
    figures = spark.createDataFrame([(run, "2024-01-01", "12.5") for run in every], "StuurtabelId int, Datum string, KostenRit string")
    done = spark.createDataFrame([(run, 1, "ja") for run in every], "StuurtabelId int, ControleId int, Done string")
    catalog = spark.createDataFrame([(1, "bestelling")], "ControleId int, Omschrijving string")
    tables = {
        "stuurtabel2_last": listed.toDF("StuurtabelId", "Omschrijving", "Soortvervoer"), "gecontroleerdeRittenDetail": rides,
        "gecontroleerdeVARittenDetail": rides, "gecontroleerdeRoutesDetail": routes, "kentallen_route": figures,
        "controleDone": done, "controle": catalog,
    }
    return lambda table: tables[table]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path), "demo")


def runs_of(frame):
    return sorted({int(row.stuurtabel_id) for row in frame.collect()})


def test_two_snapshots_then_nothing_new(spark, store):
    first = sync.sync_client(store, source(spark, [1, 2, 3]), DAY).first()
    assert (first.new_ids, first.expired_ids, first.message) == ([1, 2, 3], [], "Sync completed")
    assert first.current_counts["ritten_detail"] == 4 and first.current_counts["va_ritten_detail"] == 2
    assert first.records_synced == sum(count for name, count in first.current_counts.items() if name != "manifest")
    assert runs_of(store.read_current("va_ritten_detail")) == [2]

    second = sync.sync_client(store, source(spark, [2, 3, 4]), DAY.replace(day=2)).first()
    assert (second.new_ids, second.expired_ids, second.retained_ids) == ([4], [1], [2, 3])
    assert runs_of(store.read_current("ritten_detail")) == [3]
    assert runs_of(store.read_current("va_ritten_detail")) == [2, 4]
    assert runs_of(store.read_history("ritten_detail")) == [1]
    assert second.history_counts["ritten_controls_long"] == 2
    assert runs_of(store.manifest()) == [2, 3, 4]
    assert store.read_current("executed_controls").where("omschrijving = 'bestelling' and uitgevoerd").count() == 3

    version = store.manifest_version()
    third = sync.sync_client(store, source(spark, [2, 3, 4]), DAY.replace(day=3)).first()
    assert third.message == sync.NOTHING_NEW and third.records_synced == 0
    assert store.manifest_version() == version

    audit = spark.read.parquet(store.folder("sync_audit", "current"))
    assert audit.count() == 3
    assert sync.latest_sync(audit).first().message == sync.NOTHING_NEW


def test_a_sync_that_fails_half_way_can_be_repeated(spark, store, monkeypatch):
    sync.sync_client(store, source(spark, [1, 3]), DAY)
    before = store.read_current("ritten_detail").count()

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(sync, "_store_new", broken)
    with pytest.raises(RuntimeError):
        sync.sync_client(store, source(spark, [3, 5]), DAY.replace(day=2))
    assert store.read_current("ritten_detail").count() == before
    monkeypatch.undo()
    sync.sync_client(store, source(spark, [3, 5]), DAY.replace(day=3))
    assert runs_of(store.read_current("ritten_detail")) == [3, 5]
    assert store.read_history("ritten_detail").count() == 2


def test_unlisted_runs_are_dropped_on_request(spark, store):
    sync.sync_client(store, source(spark, [1, 3]), DAY)
    sync.sync_client(store, source(spark, [3, 5]), DAY.replace(day=2))
    before = sorted(map(tuple, store.read_current("ritten_detail").select("stuurtabel_id", "id").collect()))
    assert store.drop_unlisted("ritten_detail") == 1
    assert store.drop_unlisted("ritten_detail") == 0
    assert sorted(map(tuple, store.read_current("ritten_detail").select("stuurtabel_id", "id").collect())) == before


def test_types_that_differ_between_syncs_fit_together(spark, store):
    for version, kind in (("1", "int"), ("2", "double"), ("3", "string")):
        rows = spark.createDataFrame([(int(version), 7, version)], "stuurtabel_id int, v int, perceel string")
        store.write_version("ritten_detail", rows.withColumn("v", F.col("v").cast(kind)), version)
    rows = store.read_current("ritten_detail", {run: {"ritten_detail": str(run)} for run in (1, 2, 3)})
    kinds = dict(rows.dtypes)
    assert (kinds["v"], kinds["perceel"], kinds["stuurtabel_id"]) == ("string", "double", "bigint")
    assert sorted((row.stuurtabel_id, row.v, row.perceel) for row in rows.collect()) == [(1, "7", 1.0), (2, "7.0", 2.0), (3, "7", 3.0)]
    # one scan, however many versions
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def changing_source(spark, runs, kind):
    """Source whose first result column has another type from sync to sync."""
    read = source(spark, runs)
    value = F.when(F.col("Id") % 2 == 1, "niet ok").otherwise("ok") if kind == "string" else F.col("Resultaat_1")
    return lambda table: read(table).withColumn("Resultaat_1", value) if table == "gecontroleerdeRittenDetail" else read(table)


def test_a_result_that_changes_its_type_does_not_block_later_syncs(spark, store):
    sync.sync_client(store, changing_source(spark, [1, 3], "string"), DAY)
    second = sync.sync_client(store, changing_source(spark, [3, 5], "int"), DAY.replace(day=2)).first()
    assert second.message == "Sync completed"
    found = {(row.stuurtabel_id, row.resultaat_1) for row in store.read_current("ritten_detail").collect()}
    assert found == {(3, "ok"), (3, "niet ok"), (5, "0"), (5, "1")}
    third = sync.sync_client(store, changing_source(spark, [5], "int"), DAY.replace(day=3)).first()
    assert third.expired_ids == [3]
    assert {(row.stuurtabel_id, row.resultaat_1) for row in store.read_history("ritten_detail").collect()} == {
        ("1", "ok"), ("1", "niet ok"), ("3", "ok"), ("3", "niet ok")
    }
    flags = store.read_current("ritten_controls_long").where("controle_id = 1").select("resultaat", "is_deviation").collect()
    assert {(row.resultaat, row.is_deviation) for row in flags} == {("0", False), ("1", True)}


def test_a_run_that_appears_during_a_sync_is_fetched_by_the_next(spark, store):
    read, reads = source(spark, [1, 3, 5]), []

    def growing(table):
        rows = read(table)
        if table == "stuurtabel2_last":
            reads.append(table)
            return rows.where("StuurtabelId < 5") if len(reads) == 1 else rows
        return rows

    first = sync.sync_client(store, growing, DAY).first()
    assert len(reads) == 1 and first.current_ids == [1, 3] and runs_of(store.manifest()) == [1, 3]
    second = sync.sync_client(store, growing, DAY.replace(day=2)).first()
    assert second.new_ids == [5] and runs_of(store.read_current("ritten_detail")) == [1, 3, 5]


def listed_runs(store):
    return store.manifest().select("stuurtabel_id", "omschrijving", "soortvervoer")


def lines(frame):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


def test_dashboards_of_a_stored_client_read_no_detail_rows(spark, store):
    sync.sync_client(store, source(spark, [1, 2, 3]), DAY)
    sync.sync_client(store, source(spark, [2, 3, 5]), DAY.replace(day=2))
    runs, details = listed_runs(store), {name: store.read_current(name) for name in measures.MEASURED}
    trend = measures.stored_trend(store, runs)
    assert lines(trend) == lines(control_trend(runs, details)) and trend.count() > 0
    metrics = measures.stored_metrics(store, runs)
    assert lines(metrics) == lines(dashboard_metrics(runs, entity_counts({name: details[name] for name in measures.RIDE_DATASETS})))
    for frame in (trend, metrics):
        files = frame.inputFiles()
        assert any("dataset=measures" in file for file in files)
        assert not any("_detail" in file for file in files)


def test_runs_without_counts_and_columns_that_came_later(spark, store):
    """Version 1 has no counts, version 2 lacks a control, version 3 has it; results are those of the rows."""
    frames = {
        "1": "(1, 10, '1', null, 'a')", "2": "(2, 20, '0', null, null), (2, 21, '2', null, 'b')", "3": "(3, 30, '0', '1', 'c'), (3, 31, '1', '0', null)",
    }
    for version, values in frames.items():
        rows = spark.sql(f"select cast(col1 as bigint) as stuurtabel_id, cast(col2 as bigint) as id, col3 as resultaat_3, col4 as resultaat_10, col5 as route_nummer from values {values}")
        store.write_version("routes_detail", rows if version == "3" else rows.drop("resultaat_10"), version)
        if version != "1":
            measures.keep_measures(store, ["routes_detail"], version)
    named = spark.sql("select 'demo' as client_slug, stuurtabel_id, 'r' as omschrijving, 'RG' as soortvervoer, true as is_current, current_timestamp() as sync_timestamp, "
                      "map('routes_detail', cast(stuurtabel_id as string)) as data_versions from values 1L, 2L, 3L as t(stuurtabel_id)")  # fmt: skip
    store.publish(named, "9")
    controls = measures.stored_controls(store, ["routes_detail"])
    assert controls == {"routes_detail": [3, 10]}
    found = {(row.stuurtabel_id, row.control_id): (row.total_checked, row.total_deviations) for row in measures.stored_measures(store, controls).collect()}
    assert found == {(1, 3): (1, 1), (1, 10): (1, 0), (2, 3): (2, 1), (2, 10): (1, 0), (3, 3): (2, 1), (3, 10): (1, 1)}
    entities = measures.stored_entity_counts(store, ["routes_detail"]).collect()
    assert {row.stuurtabel_id: (row.total_checked, row.total_deviations) for row in entities} == {1: (1, 1), 2: (2, 1), 3: (2, 2)}
    assert measures.current_counts(store, ["routes_detail", "ritten_detail"]) == {"routes_detail": 5, "ritten_detail": 0}


def test_writes_count_their_rows(spark, store):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "stuurtabel_id bigint, v string")
    assert store.write_version("executed_controls", rows, "1") == 3
    assert store.write_version("executed_controls", rows.where("false"), "2") == 0
    assert store.append_history("executed_controls", rows, DAY) == 3


def test_history_partitions(spark, store):
    rows = spark.createDataFrame([(7, "a"), (None, "b")], "stuurtabel_id int, v string")
    store.append_history("ritten_detail", rows, DAY)
    found = {(row.stuurtabel_id, row.year, row.month) for row in store.read_history("ritten_detail").collect()}
    assert found == {("7", 2024, 5), ("unknown", 2024, 5)}
    with pytest.raises(ValueError):
        store.append_history("ritten_detail", rows.drop("stuurtabel_id"), DAY)


def test_unstored_datasets_read_as_empty(store):
    assert store.read_current("ritten_detail").count() == 0
    assert store.read_history("ritten_detail") is None
    assert store.manifest_version() is None


def test_run_diff_is_complete(spark):
    local, remote = ([(run,) for run in ids] for ids in ((1, 2, 3), (2, 3, 4, 4)))
    diff = sync.run_diff(spark.createDataFrame(local, "stuurtabel_id int"), spark.createDataFrame(remote, "stuurtabel_id int"))
    assert {row.stuurtabel_id: row.status for row in diff.collect()} == {1: "expired", 2: "retained", 3: "retained", 4: "new"}


def test_transport_split(spark):
    df = spark.createDataFrame([(" va ",), ("VA",), ("RG",), (None,), ("x",)], "s string")
    assert [row.g for row in df.select(sync.transport_group(F.col("s")).alias("g")).collect()] == ["VA", "VA", "RG", "RG", "RG"]


def test_backfill_replaces_key_figures_and_reports_failures(spark, store, tmp_path):
    sync.sync_client(store, source(spark, [1, 3]), DAY)
    fixed = source(spark, [1, 3])
    better = lambda table: fixed(table).withColumn("KostenRit", F.lit("99")) if table == "kentallen_route" else fixed(table)
    assert sync.backfill_key_figures(store, better, DAY.replace(day=2)) == 2
    assert {row.kosten_rit for row in store.read_current("kentallen_route").collect()} == {"99"}
    assert store.read_current("ritten_detail").count() == 4

    def unreachable(table):
        raise RuntimeError("geen verbinding")

    other = Store(spark, str(tmp_path), "other")
    other.publish(store.manifest(), "1")
    with pytest.raises(RuntimeError, match="other: geen verbinding"):
        sync.backfill_clients([(other, unreachable), (store, better)], DAY.replace(day=3))


def test_clients_are_kept_apart(spark, store, tmp_path):
    sync.sync_client(store, source(spark, [1]), DAY)
    assert Store(spark, str(tmp_path), "other").read_current("ritten_detail").count() == 0
    assert "client" not in store.read_current("ritten_detail").columns


def test_table_names_and_shared_folder(spark, tmp_path):
    assert table_name("controle") == "facturatie.controle"
    assert table_name("controle", {"controle": "x.y"}) == "x.y"
    assert table_name("controle", schema="eigen") == "eigen.controle"
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    spark.range(3).write.parquet(f"{tmp_path}/controle.parquet")
    assert parquet_reader(spark, str(tmp_path))("controle").count() == 3


@pytest.mark.parametrize("named", ["file:///shared/scratch", "/shared/scratch", "hdfs://store/scratch"])
def test_a_cluster_uses_the_folder_that_is_named(named):
    conf = {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": "file:///warehouse"}
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://head:7077"), _jsc=None)
    assert shared_folder(cluster) == named
    del conf["spark.checkpoint.dir"]
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_csv_export_keeps_order_and_headers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "a", None), (2, "c", 1.0)], "stuurtabel_id int, kenteken string, km double")
    write_csv(Detail(rows, ["kenteken"]), ["Kenteken", "Km"], f"{tmp_path}/csv", 1)
    lines = [line.value for line in spark.read.text(f"{tmp_path}/csv").collect()]
    assert lines[0] == "Kenteken,Km"
    assert [line for line in lines if line != "Kenteken,Km"] == ['a,""', "b,2.0"]


def test_rides_are_written_where_they_are_and_small_tables_are_dealt_by_run(spark, store):
    """Wide rows are not moved to share files: a run has a file of each task that holds rows of it."""
    rows = spark.range(0, 30, 1, 3).selectExpr("id % 2 as stuurtabel_id", "id", "'x' as kosten_rit")
    for dataset, files in (("ritten_detail", 6), ("va_ritten_detail", 6), ("ritten_controls_long", 6), ("kentallen_route", 2)):
        assert store.write_version(dataset, rows, "1") == 30
        held = store.read_version(dataset, "1")
        assert len(held.inputFiles()) == files and held.count() == 30
        assert store.append_history(dataset, rows.withColumn("stuurtabel_id", F.expr("nullif(stuurtabel_id, 0)")), DAY) == 30
        kept = store.read_history(dataset)
        assert len(kept.inputFiles()) == files and runs_of(kept.where("stuurtabel_id <> 'unknown'")) == [1] and kept.count() == 30
