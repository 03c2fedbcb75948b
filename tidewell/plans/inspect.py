"""Reading physical plans: what a scan pushes and reads, and which operators ran."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def formatted(df: DataFrame) -> str:
    """The text of explain("formatted")."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def operators(df: DataFrame) -> Counter:
    """Physical operators by name."""
    return Counter(m[1] for m in re.finditer(r"^\(\d+\) ([A-Za-z]+)", formatted(df), re.M))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", formatted(df))


def read_schemas(df: DataFrame) -> list[list[str]]:
    """Columns that each scan reads."""
    return [[c.split(":")[0] for c in m.split(",") if ":" in c] for m in re.findall(r"ReadSchema: struct<(.*)>", formatted(df))]
