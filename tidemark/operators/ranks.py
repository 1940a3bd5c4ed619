"""Row numbers and running sums in groups of any size: a group is cut into ranges of its order, so that no task sorts more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.sizes import sized
from tidemark.session import stored

#: Rows of a range, on average, and the number of ranges beyond which they get longer instead.
RANGE_ROWS, MOST_RANGES = 200_000, 10_000


def running(rows: DataFrame, by: list[str], order: list[Column], cost: Column | None = None, most: int | None = None) -> DataFrame:
    """``rows`` with ``row_no`` (from 1), ``total`` (rows of the group) and, for a ``cost`` of 0 or more, ``used`` (its running sum, a null counting 0).

    Groups are those of the columns ``by``, a null being a group of its own; rows that tie in ``order`` stand in any order. ``most`` keeps rows whose
    ``used`` is within it; ranges that begin beyond it aren't sorted. The added names, ``__part`` and ``__cost`` must not be in ``rows``.
    """
    own = rows.columns
    n = max(1, min(MOST_RANGES, rows.count() // RANGE_ROWS))
    d = rows.withColumn("__cost", F.coalesce(cost, F.lit(0)) if cost is not None else F.lit(0))
    d = stored(d.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    group = Window.partitionBy(*by)  # a row for each range of a group
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.sum("__cost").alias("__c"))
    parts = parts.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c0"), F.sum("__n").over(group).alias("total"))
    if most is not None:
        parts = parts.where(F.col("__c0") <= most)
    on = F.col("__part") == F.col("__p")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__{b}"))
    d = d.join(sized(stored(parts)), on)
    w = Window.partitionBy(*by, "__part").orderBy(*order)
    d = d.withColumn("row_no", F.col("__n0") + F.row_number().over(w))
    if cost is None:
        return d.select(*own, "row_no", "total")
    d = d.withColumn("used", F.col("__c0") + F.sum("__cost").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (d if most is None else d.where(F.col("used") <= most)).select(*own, "row_no", "total", "used")
