"""Loading of the named Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

NAMES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the path may be in any store Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names) -> None:
    """Register temp views for the SQL forms of the operators."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
