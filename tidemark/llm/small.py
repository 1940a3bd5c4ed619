"""Joins whose small side is broadcast only after its size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that may be broadcast.
MOST = 32 << 20


def sized(side: DataFrame, entries: int, width: int = 32) -> DataFrame:
    """``side`` with a broadcast hint if its ``entries`` (rows, or array items) of ``width`` bytes take at most MOST; beyond that Spark shuffles both sides."""
    return F.broadcast(side) if entries * width <= MOST else side
