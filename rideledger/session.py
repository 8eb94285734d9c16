"""Session settings the operators are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Wide control rows make generated methods that the JVM would refuse to compile (above
    # 8000 bytes of bytecode it interprets them). Past this size Spark splits the work instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Stored runs differ in size; let Spark size, split and join partitions from what it measures.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dates are calendar dates wherever a job runs.
    "spark.sql.session.timeZone": "UTC",
}
# Only possible when a session is started: reports are built from many small column
# expressions, and looking up the call site of each of them takes longer than planning.
STARTUP = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
