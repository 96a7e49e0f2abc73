"""Joins with configuration: broadcast while it is small, which is looked up and not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent to every executor.
SMALL_ROWS = 50_000


def small_side(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most SMALL_ROWS rows; else as it is, and the join shuffles.

    A table made on the driver has no size the planner knows, so without the hint the other side would be shuffled to meet it.
    """
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df
