"""A session with the settings the library is meant to run with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "lodegrid", **settings: str) -> SparkSession:
    """Adaptive execution, Arrow, UTC. Dotted settings are given with double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch, about: what a Python worker holds of its input at once, however long the rows are.
BATCH_BYTES = 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of BATCH_BYTES at most, or of one row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    jvm = spark._jvm.org.apache.spark.network.util.JavaUtils
    if not 0 < jvm.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _shared(spark: SparkSession) -> str:
    """Where this application's files go: below spark.checkpoint.dir; in single-JVM local mode without one a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodegrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/files/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path that all executors share."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that was written to scratch paths by this application. Call it when results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_shared(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
