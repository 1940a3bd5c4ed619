"""Connected components of a large set of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): root is the smallest node reachable; each is its own in none.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones too; both are minima
    by key, summed up before they are dealt out. Rounds grow with the logarithm of the longest chain. Only two numbers a
    round reach the driver. Loops and repeated links do no harm; no links give no rows.
    """
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    sign = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64("hi", "lo"), 24)), F.lit(0))).first()
    was = sign(e)
    while was[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.join(low, e.lo == low.u).select("hi", F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
        moved = large.join(least, large.hi == least.u).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        e = cut(moved.unionAll(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        now = sign(e)
        if now == was:
            break
        was = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
