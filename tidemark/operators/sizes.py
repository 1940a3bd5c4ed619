"""Joins whose small side is broadcast only after it was counted, and partitions by numbers of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stored

#: Bytes that may be broadcast.
MOST = 32 << 20
#: Rows that a task may sort or group, so that its memory stays the same when tables grow.
ROWS = 1 << 20


def sized(side: DataFrame, width: int = 64) -> DataFrame:
    """``side``, rows of about ``width`` bytes, with a broadcast hint if it takes at most MOST; beyond that Spark shuffles both sides."""
    most = MOST // width
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def held(side: DataFrame, width: int = 64) -> DataFrame:
    """``side`` computed once: as rows in the plan with a broadcast hint if it takes at most MOST, for rows of about ``width`` bytes, else as a stored table."""
    most = MOST // width
    rows = side.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        return F.broadcast(side.sparkSession.createDataFrame(rows, side.schema))
    return stored(side)


def parts(rows: int, spark: SparkSession) -> int:
    """Partitions for ``rows`` rows: the session's number, and more where that would leave a task over ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
