"""Stored datasets of a client: a current area, a history area and the run manifest.

Layout below the root folder::

    client=<slug>/dataset=<name>/current/version=<v>/stuurtabel_id=<run>/
    client=<slug>/dataset=<name>/history/year=<y>/month=<m>/stuurtabel_id=<run>/version=<v>/
    client=<slug>/dataset=<name>/columns/version=<v>/
    client=<slug>/dataset=manifest/current/version=<v>/
    client=<slug>/dataset=measures/current/version=<v>/

A write never touches files that are being read. New runs go to a folder of their own
version and become visible when a manifest that names them has been written completely;
runs that stay are not rewritten. A failed job leaves folders no manifest names, and
repeating it is safe. Columns have declared types (``sources/schema.py``); their names are noted
beside the data, so nothing has to merge schemas from file footers.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rideledger.fixed_values import LONG_DATASETS
from rideledger.registry import RUN
from rideledger.sources.schema import as_stored, read_schema

MANIFEST_SCHEMA = (
    "client_slug string, stuurtabel_id bigint, omschrijving string, soortvervoer string, is_current boolean, "
    "sync_timestamp timestamp, data_versions map<string,string>"
)
MEASURES_SCHEMA = "stuurtabel_id bigint, dataset string, control_id int, total_checked bigint, total_deviations bigint"
# What is certain about a dataset of which nothing has been stored yet.
BARE_SCHEMA = "client_slug string, stuurtabel_id bigint"


# Rides, and the control rows that are made from stored files, of which each holds one run.
LARGE = {"ritten_detail", "va_ritten_detail", *LONG_DATASETS}
SCRATCH = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    The setting is trusted, a path without a scheme or one of files too: whether machines mount the same folder cannot
    be told from its name. Where all work is done on one machine and nothing is named, a folder below the warehouse serves.
    """
    folder = spark.conf.get(SCRATCH, None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    if not folder:
        raise ValueError(f"{SCRATCH} must name a folder that all executors share")
    return folder


def _counted(rows: DataFrame, seen: Observation) -> DataFrame:
    """Rows counted by the tasks that write them.

    Counting comes last, after any shuffle: there a task that is repeated counts once.
    """
    return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"))


class Store:
    """Datasets of one client below a root folder."""

    def __init__(self, spark: SparkSession, root: str, client: str):
        self.spark = spark
        self.client = client
        self.home = f"{root}/client={client}"

    def folder(self, dataset: str, area: str) -> str:
        return f"{self.home}/dataset={dataset}/{area}"

    def _matches(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(status.getPath().toString() for status in found or [])

    # Manifest.

    def manifest_version(self) -> str | None:
        """The newest manifest that was written completely."""
        done = self._matches(f"{self.folder('manifest', 'current')}/version=*/_SUCCESS")
        return done[-1].rsplit("version=", 1)[1].split("/")[0] if done else None

    def manifest(self) -> DataFrame:
        version = self.manifest_version()
        if version is None:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.folder('manifest', 'current')}/version={version}")

    def publish(self, manifest: DataFrame, version: str) -> None:
        """Make a list of runs the current one."""
        path = f"{self.folder('manifest', 'current')}/version={version}"
        manifest.coalesce(1).write.mode("errorifexists").parquet(path)

    # Current area.

    def current_versions(self) -> dict[int, dict[str, str]]:
        """Run id to the version of each of its datasets; one entry per invoice run."""
        return {row[RUN]: row.data_versions for row in self.manifest().select(RUN, "data_versions").collect()}

    def _note_columns(self, dataset: str, names: list[str], version: str) -> None:
        rows = self.spark.createDataFrame(list(enumerate(names)), "place int, name string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder(dataset, 'columns')}/version={version}")

    def columns(self, dataset: str, version: str = "*") -> list[str]:
        """Names of the stored columns, of one version or of all."""
        path = f"{self.folder(dataset, 'columns')}/version={version}"
        if not self._matches(f"{path}/_SUCCESS"):
            return []
        noted = self.spark.read.schema("place int, name string").parquet(path)
        found = noted.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()
        return [row.name for row in found]

    def _read(self, dataset: str, area: str, paths: list[str], names: list[str], **kinds: str) -> DataFrame:
        reader = self.spark.read.schema(read_schema(dataset, names, **kinds)).option("basePath", self.folder(dataset, area))
        return reader.parquet(*paths)

    def read_current(self, dataset: str, versions: dict[int, dict[str, str]] | None = None) -> DataFrame:
        """Rows of the current runs; empty when nothing was stored yet.

        One scan over the folders of the named runs, however many syncs wrote them. Give ``versions`` when
        reading several datasets, so that all show the same state.
        """
        paths = self.run_folders(dataset, self.current_versions() if versions is None else versions)
        names = self.columns(dataset)
        if not paths:
            return self.spark.createDataFrame([], read_schema(dataset, names) if names else BARE_SCHEMA)
        rows = self._read(dataset, "current", paths, names, version="string", **{RUN: "bigint"})
        return rows.select(*names)

    def run_folders(self, dataset: str, versions: dict[int, dict[str, str]]) -> list[str]:
        """Folders of the named runs that a dataset has."""
        named = {f"version={held[dataset]}/{RUN}={run}" for run, held in versions.items() if dataset in held}
        there = self._matches(f"{self.folder(dataset, 'current')}/version=*/{RUN}=*")
        return [path for path in there if "/".join(path.rsplit("/", 2)[1:]) in named]

    def drop_unlisted(self, dataset: str) -> int:
        """Delete stored runs that the manifest does not name: expired ones and those of failed jobs.

        Not part of a sync, because a reader may still use the list before. Returns how many
        run folders were deleted.
        """
        listed = {(held.get(dataset), str(run)) for run, held in self.current_versions().items()}
        deleted = 0
        for folder in self._matches(f"{self.folder(dataset, 'current')}/version=*/{RUN}=*"):
            version, run = folder.rsplit("version=", 1)[1].split(f"/{RUN}=")
            if (version, run) not in listed:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                deleted += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return deleted

    def write_version(self, dataset: str, rows: DataFrame, version: str) -> int:
        """Store rows of new runs under a version; not visible before a manifest names it. Returns their number.

        Rows of the ``LARGE`` datasets are written by the tasks that have them, as one file for each run and task: there
        are too many of them, and they are too wide, to be moved for the sake of fewer files. All others are dealt by run.
        """
        path = f"{self.folder(dataset, 'current')}/version={version}"
        rows = as_stored(dataset, rows)
        self._note_columns(dataset, rows.columns, version)
        seen = Observation()
        dealt = rows if dataset in LARGE else rows.hint("rebalance", RUN)
        _counted(dealt, seen).write.mode("overwrite").partitionBy(RUN).parquet(path)
        return seen.get["n_rows"]

    def read_version(self, dataset: str, version: str) -> DataFrame | None:
        """Rows stored under one version; None when there are none."""
        path = f"{self.folder(dataset, 'current')}/version={version}"
        if not self._matches(f"{path}/{RUN}=*"):
            return None
        names = self.columns(dataset, version)
        return self._read(dataset, "current", [path], names, version="string", **{RUN: "bigint"}).select(*names)

    def write_measures(self, measures: DataFrame, version: str) -> None:
        """Store the counts of the rows of a version."""
        measures.coalesce(1).write.mode("overwrite").parquet(f"{self.folder('measures', 'current')}/version={version}")

    def current_measures(self) -> DataFrame:
        """Stored counts of the rows that the manifest names."""
        home = self.folder("measures", "current")
        if not self._matches(f"{home}/version=*/_SUCCESS"):
            return self.spark.createDataFrame([], MEASURES_SCHEMA)
        rows = self.spark.read.schema(f"{MEASURES_SCHEMA}, version string").parquet(home)
        named = self.manifest().select(RUN, F.explode("data_versions").alias("dataset", "version"))
        return rows.join(named, [RUN, "dataset", "version"], "left_semi").drop("version")

    def replace_current(self, dataset: str, rows: DataFrame, version: str) -> int:
        """Replace a dataset for all current runs and publish that. Returns the number of rows."""
        written = self.write_version(dataset, rows, version)
        renewed = F.map_concat(
            F.map_filter("data_versions", lambda name, _: name != dataset),
            F.create_map(F.lit(dataset), F.lit(version)),
        )
        self.publish(self.manifest().withColumn("data_versions", renewed), version)
        return written

    # History area.

    def append_history(self, dataset: str, rows: DataFrame, synced_at: datetime, version: str = "none") -> int:
        """Add rows to the history by sync month and run; rows without a run go to ``unknown``. Returns their number.

        Repeating the write of the same runs and version replaces it instead of doubling it.
        """
        if RUN not in rows.columns:
            raise ValueError(f"no {RUN} column among: " + ", ".join(rows.columns))
        if "version" not in rows.columns:
            rows = rows.withColumn("version", F.lit(version))
        names = [name for name in rows.columns if name != "version"]
        self._note_columns(dataset, names, version)
        keyed = as_stored(dataset, rows).withColumns(
            {
                "year": F.lit(f"{synced_at:%Y}"),
                "month": F.lit(f"{synced_at:%m}"),
                RUN: F.coalesce(F.col(RUN).cast("string"), F.lit("unknown")),
            }
        )
        seen = Observation()
        (
            _counted(keyed if dataset in LARGE else keyed.hint("rebalance", RUN), seen)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("year", "month", RUN, "version")
            .parquet(self.folder(dataset, "history"))
        )
        return seen.get["n_rows"]

    def read_history(self, dataset: str) -> DataFrame | None:
        path = self.folder(dataset, "history")
        if not self._matches(f"{path}/year=*"):
            return None
        names = self.columns(dataset)
        kinds = {"year": "int", "month": "int", RUN: "string", "version": "string"}
        return self._read(dataset, "history", [path], names, **kinds).select(*names, "version", "year", "month")

    def remove(self) -> None:
        """Delete everything stored for the client."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
