"""Session construction for local use; on a cluster the session comes from outside."""

from __future__ import annotations

import os
import pathlib

from pyspark.sql import SparkSession


ROOT = str(pathlib.Path(__file__).resolve().parent.parent)


#: Arrow batches of texts are kept small, so that a task's memory does not follow its partition.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and keep their batches small.

    On a cluster without a common installation, send the package with --py-files. Batch
    sizes that the session has set itself stay as they are.
    """
    for key, (default, small) in ARROW.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *[p for p in paths if p]])


def local_session(cores: int | None = None, app: str = "tidewell", **conf: str) -> SparkSession:
    """A UTC, AQE-enabled local session sized by cores."""
    n = cores or os.cpu_count() or 4
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.executorEnv.PYTHONPATH", ROOT)
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
