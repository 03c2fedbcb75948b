"""Exact arithmetic on columns that arrive as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def exact(value: Column | str, kind: str = MONEY) -> Column:
    """A double as a decimal, so that sums do not depend on their order."""
    return (F.col(value) if isinstance(value, str) else value).cast(kind)
