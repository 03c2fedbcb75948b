"""Sinks and sources by format, written to the shared folder and read back with a given schema."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder for the process; a cluster gets an
    error, as each executor would write to its own disk.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = getattr(sc, "_tidewell_scratch", None)
        if own is None:
            own = sc._tidewell_scratch = tempfile.mkdtemp(prefix="tidewell-out-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def round_trip(spark: SparkSession, df: DataFrame, fmt: str, **options: str) -> DataFrame:
    """Write df in a format and read it back; the schema is given, never inferred."""
    path = scratch(spark)
    df.write.format(fmt).options(**options).save(path)
    return spark.read.format(fmt).schema(df.schema).options(**options).load(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table of the session's catalog, in `buckets` files by key, each in the key's order; read back.

    Two tables of as many buckets join on the key as they lie: no row is shuffled, and where
    ordered_buckets() is on none is sorted. The files lie in the shared folder.
    """
    spark = df.sparkSession
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", scratch(spark)).saveAsTable(name)
    return spark.table(name)


@contextmanager
def ordered_buckets(spark: SparkSession):
    """Inside, plans take the order that bucketed() wrote for granted; one file a bucket makes that safe."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write df by a column's values into a folder; of what lay there only the partitions that df has are replaced."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitioned(spark: SparkSession, df: DataFrame, by: str) -> DataFrame:
    """Write df by a column's values; scans that filter on it read those folders only."""
    path = scratch(spark)
    df.repartition(by).write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
