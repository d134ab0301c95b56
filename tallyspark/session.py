"""Session settings of the bench, the tests and the checks, and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "tallyspark", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects of any session:
    UTC, adaptive execution with skew handling.  On a cluster the submitting
    job brings its own session; nothing in the library reads these values."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below the shared one of ``spark.checkpoint.dir``.  A session on one machine
    that sets none, as in tests, gets a temporary folder; on a cluster a shared one must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyspark-")
    return f"{root.rstrip('/')}/run-{uuid.uuid4().hex}"
