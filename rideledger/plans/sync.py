"""Bring the stored datasets of a client in step with the latest invoice runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.fixed_values import DETAIL_DATASETS, LONG_DATASETS, SOURCE_TABLES
from rideledger.operators.normalise import (
    current_runs,
    join_executed_controls,
    of_runs,
    prepare,
    prepare_executed_controls,
    united,
)
from rideledger.operators.unpivot import control_rows
from rideledger.plans.measures import current_counts, keep_measures
from rideledger.registry import RUN
from rideledger.sources.datasets import Store
from rideledger.sources.tables import Reader, run_table, whole_table

AUDIT_SCHEMA = (
    "client_slug string, started_at timestamp, finished_at timestamp, status string, records_synced bigint, "
    "message string, current_ids array<bigint>, local_ids array<bigint>, new_ids array<bigint>, "
    "expired_ids array<bigint>, retained_ids array<bigint>, run_descriptions map<bigint,string>, "
    "run_transport_types map<bigint,string>, current_counts map<string,bigint>, "
    "history_counts map<string,bigint>, raw_source_columns map<string,array<string>>"
)
DATASETS = [*DETAIL_DATASETS, *LONG_DATASETS]
NOTHING_NEW = "No new current data to sync"


def run_diff(local: DataFrame, source: DataFrame) -> DataFrame:
    """Every run as new, expired or retained."""
    here = local.select(RUN).where(F.col(RUN).isNotNull()).distinct().withColumn("here", F.lit(True))
    there = source.select(RUN).where(F.col(RUN).isNotNull()).distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("here").isNull(), "new").when(F.col("there").isNull(), "expired").otherwise("retained")
    return here.join(there, RUN, "full_outer").select(RUN, status.alias("status"))


def transport_group(transport: Column) -> Column:
    """On-demand runs are ``VA``; all others, also unknown ones, are ``RG``."""
    return F.when(F.upper(F.trim(transport)) == "VA", "VA").otherwise("RG")


def merge_current(current: DataFrame, new: DataFrame, retained: list[int]) -> DataFrame:
    """Rows of the retained runs with the new rows, columns matched by name."""
    return united(of_runs(current, retained), new)


def build_manifest(runs: DataFrame, client: str, synced_at: datetime | Column) -> DataFrame:
    """Manifest rows of the current runs."""
    stamp = synced_at if isinstance(synced_at, Column) else F.lit(synced_at)
    return runs.select(
        F.lit(client).alias("client_slug"),
        RUN,
        "omschrijving",
        "soortvervoer",
        F.lit(True).alias("is_current"),
        stamp.cast("timestamp").alias("sync_timestamp"),
    )


@dataclass(frozen=True)
class RunPlan:
    """What a sync has to do. Holds run ids only, one per invoice run."""

    new: list[int]
    expired: list[int]
    retained: list[int]
    transport: dict[int, str]

    def new_of(self, transport: str) -> list[int]:
        return [run for run in self.new if self.transport[run] == transport]


def plan_runs(local: DataFrame, source: DataFrame) -> RunPlan:
    kinds = source.groupBy(RUN).agg(F.max(transport_group(F.col("soortvervoer"))).alias("kind"))
    rows = run_diff(local, source).join(kinds, RUN, "left").orderBy(RUN).collect()
    ids = {status: [row[RUN] for row in rows if row.status == status] for status in ("new", "expired", "retained")}
    return RunPlan(ids["new"], ids["expired"], ids["retained"], {row[RUN]: row.kind for row in rows})


def _extract(read: Reader, plan: RunPlan) -> dict[str, DataFrame]:
    rows = {
        dataset: run_table(read, dataset, plan.new_of("VA" if dataset == "va_ritten_detail" else "RG"))
        for dataset in DETAIL_DATASETS
        if dataset in SOURCE_TABLES
    }
    done = run_table(read, "controls_done", plan.new)
    rows["executed_controls"] = join_executed_controls(done, whole_table(read, "control_catalog"))
    return rows


def _at_once(work: Callable[[str], int], datasets: Iterable[str]) -> dict[str, int]:
    """Write several datasets side by side, so that small ones do not leave executors idle; returns the rows of each."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        started = {dataset: pool.submit(work, dataset) for dataset in datasets}
        return {dataset: done.result() for dataset, done in started.items()}


def _store_new(store: Store, extracted: dict[str, DataFrame], plan: RunPlan, synced_at: datetime, version: str) -> int:
    """Write the rows of the new runs and their counts; control rows are derived from what was just stored.

    Returns the number of rows.
    """

    def write_detail(dataset: str) -> int:
        if dataset == "executed_controls":
            rows = prepare_executed_controls(extracted[dataset], store.client, plan.new, synced_at)
        else:
            rows = prepare(dataset, extracted[dataset], store.client, plan.new, synced_at)
        return store.write_version(dataset, rows, version)

    def write_long(dataset: str) -> int:
        detail, kind = LONG_DATASETS[dataset]
        stored = store.read_version(detail, version)
        return 0 if stored is None else store.write_version(dataset, control_rows(stored, kind), version)

    written = _at_once(write_detail, extracted) | _at_once(write_long, LONG_DATASETS)
    keep_measures(store, [dataset for dataset, n_rows in written.items() if n_rows], version)
    return sum(written.values())


def _expire(store: Store, plan: RunPlan, synced_at: datetime, version: str) -> dict[str, int]:
    """Copy the expired runs of every dataset to the history; returns the rows copied."""
    if not plan.expired:
        return dict.fromkeys(DATASETS, 0)
    versions = store.current_versions()
    expired = {dataset: of_runs(store.read_current(dataset, versions), plan.expired) for dataset in DATASETS}
    return _at_once(lambda dataset: store.append_history(dataset, expired[dataset], synced_at, version), DATASETS)


def sync_client(store: Store, read: Reader, synced_at: datetime | None = None) -> DataFrame:
    """One sync of a client; returns its audit row.

    Only run ids reach the driver. Order of work: history of expired runs, rows of new
    runs, then the manifest. Readers see the old state until the manifest is complete.
    """
    started = synced_at or datetime.now(UTC)
    version = f"{started:%Y%m%d%H%M%S%f}"
    local = store.manifest()
    # The run list is read once. What a later read would say does not belong to this sync.
    listed = current_runs(read(SOURCE_TABLES["runs"])).collect()
    source = store.spark.createDataFrame(listed, f"{RUN} bigint, omschrijving string, soortvervoer string")
    plan = plan_runs(local, source)
    described = {row[RUN]: row for row in listed}
    audit = {
        "client_slug": store.client,
        "started_at": started,
        "status": "success",
        "current_ids": sorted(plan.new + plan.retained),
        "local_ids": sorted(plan.expired + plan.retained),
        "new_ids": plan.new,
        "expired_ids": plan.expired,
        "retained_ids": plan.retained,
        "run_descriptions": {run: row.omschrijving for run, row in described.items()},
        "run_transport_types": {run: row.soortvervoer for run, row in described.items()},
    }
    if not plan.new and not plan.expired:
        audit |= {"message": NOTHING_NEW, "records_synced": 0, "current_counts": {}, "history_counts": {}}
        audit["raw_source_columns"] = {dataset: [] for dataset in DETAIL_DATASETS}
        return _audited(store, audit)

    extracted = _extract(read, plan)
    audit["history_counts"] = _expire(store, plan, started, store.manifest_version() or "none")
    audit["records_synced"] = _store_new(store, extracted, plan, started, version)
    kept = local.select(RUN, F.col("data_versions").alias("kept"))
    fresh = F.create_map(*[F.lit(text) for dataset in DATASETS for text in (dataset, version)])
    texts = [F.max(name).alias(name) for name in ("omschrijving", "soortvervoer")]
    one_per_run = source.groupBy(RUN).agg(*texts)
    manifest = build_manifest(one_per_run, store.client, started).join(kept, RUN, "left")
    current = manifest.withColumn("data_versions", F.coalesce("kept", fresh)).drop("kept")
    store.publish(current.select(*local.columns), version)

    audit["current_counts"] = current_counts(store, DATASETS) | {"manifest": len(plan.new) + len(plan.retained)}
    audit["raw_source_columns"] = {dataset: rows.columns for dataset, rows in extracted.items()}
    audit["message"] = "Sync completed"
    return _audited(store, audit)


def _audited(store: Store, audit: dict) -> DataFrame:
    """Append the audit row to the audit table of the client."""
    audit["finished_at"] = datetime.now(UTC)
    names = [field.split(" ")[0] for field in AUDIT_SCHEMA.split(", ")]
    row = store.spark.createDataFrame([tuple(audit[name] for name in names)], AUDIT_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(store.folder("sync_audit", "current"))
    return row


def newest_rows(history: DataFrame, keys: list[str]) -> DataFrame:
    """History rows without repeats: per key the row of the last sync."""
    newest = F.max_by(F.struct(*history.columns), F.col("synced_at"))
    return history.groupBy(*keys).agg(newest.alias("newest")).select("newest.*")


def latest_sync(audit: DataFrame) -> DataFrame:
    """The newest audit row of each client."""
    newest = F.max_by(F.struct(*audit.columns), F.col("started_at"))
    return audit.groupBy("client_slug").agg(newest.alias("newest")).select("newest.*")


def backfill_key_figures(store: Store, read: Reader, synced_at: datetime | None = None) -> int:
    """Extract the key figures of all current runs again and replace the stored ones."""
    started = synced_at or datetime.now(UTC)
    runs = sorted(row[RUN] for row in store.manifest().select(RUN).distinct().collect())
    if not runs:
        return 0
    rows = prepare("kentallen_route", run_table(read, "kentallen_route", runs), store.client, runs, started)
    return store.replace_current("kentallen_route", rows, f"{started:%Y%m%d%H%M%S%f}")


def backfill_clients(clients: list[tuple[Store, Reader]], synced_at: datetime | None = None) -> dict[str, int]:
    """Backfill client by client; one that fails does not stop the others, but is reported."""
    rows, failures = {}, []
    for store, read in clients:
        try:
            rows[store.client] = backfill_key_figures(store, read, synced_at)
        except Exception as problem:  # noqa: BLE001 - collected and raised below
            failures.append(f"{store.client}: {problem}")
    if failures:
        raise RuntimeError("backfill failed for " + " | ".join(failures))
    return rows
