"""The versioned-memory model derived from the driver tables; each builder is beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.tables import table


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bi-temporal versions: one for each order; a customer's orders follow each other in valid time."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    one = Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")
    line = Window.partitionBy("logical_id").orderBy("valid_from", "version_id")
    v = o.withColumn("rn", F.row_number().over(one)).where("rn = 1").join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    v = v.select(
        k.alias("version_id"),
        F.col("o_custkey").alias("logical_id"),
        F.col("o_orderdate").alias("valid_from"),
        F.col("o_orderpriority").alias("kind"),
        F.col("o_orderstatus").alias("status"),
        (1 + k % 10).alias("importance"),
        F.expr("o_orderdate + make_dt_interval(int(o_orderkey % 7))").alias("recorded_at"),
        F.array(F.col("c_nationkey"), 25 + F.col("c_nationkey") % 5).alias("project_ids"),
        F.when(k % 3 == 0, "all").when(k % 3 == 1, "class:work").otherwise(F.concat(F.lit("device:"), (k % 11).cast("string"))).alias("device_scope"),
        F.col("o_totalprice").alias("weight"),
    )
    nxt = F.lead("recorded_at").over(line)
    return v.withColumn("valid_to", F.lead("valid_from").over(line)).withColumn("superseded_at", F.when(nxt > F.col("recorded_at"), nxt))


VERSIONS = """
base AS (SELECT o_orderkey AS version_id, o_custkey AS logical_id, o_orderdate AS valid_from, o_orderpriority AS kind, o_orderstatus AS status, 1 + o_orderkey % 10 AS importance,
    o_orderdate + to_days(CAST(o_orderkey % 7 AS INTEGER)) AS recorded_at, c_nationkey AS nation, [c_nationkey, 25 + c_nationkey % 5] AS project_ids,
    CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'class:work' ELSE 'device:' || (o_orderkey % 11) END AS device_scope, o_totalprice AS weight
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS rn FROM orders) JOIN customer ON o_custkey = c_custkey WHERE rn = 1),
versions AS (SELECT *, lead(valid_from) OVER line AS valid_to, CASE WHEN lead(recorded_at) OVER line > recorded_at THEN lead(recorded_at) OVER line END AS superseded_at
  FROM base WINDOW line AS (PARTITION BY logical_id ORDER BY valid_from, version_id))
"""


def chunks(spark: SparkSession, sf_dir: str, size: int = 40, lap: int = 4) -> DataFrame:
    """Word windows of the documents: chunk_id, doc_id, ordinal, words. From ordinal 1000 on a chunk_id stands in the next document's ids, so doc_id and chunk_id are the key."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "").alias("w"))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - lap) / F.lit(size - lap)) - 1).cast("int")
    d = d.where(F.size("w") > 0).select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    return d.select((F.col("doc_id") * 1000 + F.col("ordinal")).alias("chunk_id"), "doc_id", "ordinal", F.slice("w", F.col("ordinal") * (size - lap) + 1, F.lit(size)).alias("words"))


CHUNKS = r"""
cw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
chunks AS (SELECT doc_id * 1000 + ordinal AS chunk_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal, w[ordinal * 36 + 1:ordinal * 36 + 40] AS words
  FROM (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 4) / 36) AS BIGINT)))) AS ordinal FROM cw WHERE len(w) > 0))
"""


def edges(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Supersession links from newer to older items, one for the first line of each order: the graph grows with the data. ``parts``: partitions they are told apart in."""
    li = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_partkey"), F.col("l_suppkey") * 7
    e = li.where("l_linenumber = 1").select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).where("src <> dst")
    return (e.repartition(parts, "src", "dst") if parts else e).distinct()


EDGES = "edges AS (SELECT DISTINCT greatest(l_partkey, l_suppkey * 7) AS src, least(l_partkey, l_suppkey * 7) AS dst FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_suppkey * 7)"
