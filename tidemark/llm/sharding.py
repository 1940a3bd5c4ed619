"""Sharding by a tree of weighted hash draws over regions, racks and shards (law: key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.small import sized
from tidemark.llm.text import let
from tidemark.session import cut

SHARDS = 24
#: Shards of a region and of a rack: planned shard s stands in region s // REGION and there in rack s % REGION // RACK.
REGION, RACK = 12, 4
#: Rows of an id range, on average; a task numbers those of one range and shard.
RANGE_ROWS = 100_000


def tree(shards: int, planned: int = SHARDS) -> tuple[list[list[int]], list[list[int]]]:
    """(racks of each region, shards of each rack). Shards beyond the planned ones open a region of their own each."""
    first = [list(range(r, min(r + REGION, planned, shards))) for r in range(0, min(planned, shards), REGION)]
    first += [[s] for s in range(planned, shards)]
    regions: list[list[int]] = []
    racks: list[list[int]] = []
    for held in first:
        cut_ = [held[i : i + RACK] for i in range(0, len(held), RACK)]
        regions.append(list(range(len(racks), len(racks) + len(cut_))))
        racks += cut_
    return regions, racks


def _chosen(key: Column, level: int, nodes: Column, weights: list[float]) -> Column:
    """The node with the least exponential draw, the first of equals. A draw depends on key, level, node and the node's weight alone."""
    rates = F.array(*(F.lit(float(w)) for w in weights))

    def draw(node: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(level), node, key), 11) + F.lit(1)) / F.lit(float((1 << 53) + 1))
        rate = F.get(rates, node)
        return F.when(rate > 0, -F.ln(u) / rate).otherwise(F.lit(float("inf")))

    return let(F.transform(nodes, draw), lambda d: F.get(nodes, (F.array_position(d, F.array_min(d)) - 1).cast("int")))


def descend(key: Column, shards: int, weights: list[float] | None = None, planned: int = SHARDS) -> Column:
    """The shard of ``key``: one region by weighted draws, then one of its racks, then one of the rack's shards; only these nodes' draws are made.

    A node weighs what its shards weigh together and has a draw of its own, so nodes and shards are chosen by weight. Another weight for a shard
    changes the draws of that shard, its rack and its region and no others: rows move between regions only into or out of that region, within it
    only into or out of that rack, and within the rack only into or out of that shard. A shard beyond the planned ones is a region of its own, so it
    takes rows only into itself. A shard of weight 0 gets nothing, if any other weighs more.
    """
    weights = weights or [1.0] * shards
    regions, racks = tree(shards, planned)
    of_racks = [sum(weights[s] for s in rack) for rack in racks]
    of_regions = [sum(of_racks[k] for k in region) for region in regions]
    below = lambda lists, node: F.get(F.array(*(F.array(*map(F.lit, x)) for x in lists)), node)
    region = _chosen(key, 0, F.array(*map(F.lit, range(len(regions)))), of_regions)
    rack = let(region, lambda r: _chosen(key, 1, below(regions, r), of_racks))
    return let(rack, lambda k: _chosen(key, 2, below(racks, k), weights))


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, weights: list[float] | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the number of shards decide; null ids share one draw. Slots count a shard's rows from 0 by (doc_id, text_crc32, size), nulls first:
    rows are dealt into id ranges and numbered by range and shard, and each range starts where the counts of those before it end. Equal rows
    get different slots in no set order. size is UTF-8 bytes plus 8; a null text has none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(id_col), F.lit(-1))
    more = weights + [1.0] if weights else None
    planned = min(shards, SHARDS)
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(t) + 8).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, shards, weights, planned).alias("shard"),
        descend(key, shards + 1, more, planned).alias("grown_shard"),
    )
    order = ["doc_id", "text_crc32", "size"]
    ranges = max(1, docs.count() // RANGE_ROWS)
    d = cut(d.repartitionByRange(ranges, *order).withColumn("run", F.spark_partition_id()))
    counts = d.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start"))  # a row for each shard and range
    own = F.row_number().over(Window.partitionBy("shard", "run").orderBy(*order))
    d = d.withColumn("own", own).join(sized(starts, ranges * shards), ["shard", "run"])
    return d.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("own") - 1).cast("long").alias("slot"), "grown_shard")
