"""Broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes.
LIMIT = 16 << 20


def small(side: DataFrame, row_bytes: int, limit: int = LIMIT) -> DataFrame:
    """The side, marked for broadcast if its rows, counted up to one more than fit, take at most ``limit`` bytes; else Spark picks the join."""
    most = max(1, limit // row_bytes)
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side
