"""What the operators need from a cluster: shared scratch space, settled frames, shipped code."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_REMEMBERED: dict[str, Any] = {}
PACKAGE = Path(__file__).resolve().parent.parent


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    A local one is made only where the setting is missing and everything runs in one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder below the shared one that nobody uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; cuts the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to a new table in the shared folder; cuts the lineage and prunes columns."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next: one thing only, so that no operator's memory adds to another's."""
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        give_back()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def give_back() -> None:
    """Return free memory of this Python worker to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per session."""
    context = spark.sparkContext
    if getattr(context, "_rideledger_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="rideledger-")) / "rideledger.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._rideledger_shipped = True
