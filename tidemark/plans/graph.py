"""Link graphs: ancestors, closure, cycles, supersession."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import graph as G
from tidemark.operators.sizes import parts
from tidemark.plans.registry import operator
from tidemark.sources.model import EDGES, VERSIONS, edges, versions
from tidemark.sources.tables import table


def parents(spark, sf):
    w = Window.partitionBy("logical_id").orderBy("valid_from", "version_id")
    v = versions(spark, sf)
    same = F.lag("status").over(w) == F.col("status")
    return v.select(F.col("version_id").alias("node"), F.when(same, F.lag("version_id").over(w)).alias("parent"))


_PAR = f"{VERSIONS}, par AS (SELECT version_id AS node, CASE WHEN lag(status) OVER w = status THEN lag(version_id) OVER w END AS parent FROM versions WINDOW w AS (PARTITION BY logical_id ORDER BY valid_from, version_id))"


@operator(f"WITH RECURSIVE {_PAR}, c AS (SELECT node, parent AS ancestor, 1 AS depth FROM par WHERE parent IS NOT NULL UNION ALL SELECT c.node, p.parent, c.depth + 1 FROM c JOIN par p ON p.node = c.ancestor WHERE p.parent IS NOT NULL) SELECT node, ancestor, depth FROM c")
def ancestor_chain(spark, sf):
    """All predecessors with an unchanged status."""
    return G.chains(parents(spark, sf))


@operator(f"WITH {EDGES} SELECT DISTINCT e.dst, e.src, f.dst AS next FROM edges e LEFT JOIN edges f ON f.src = e.dst")
def one_hop(spark, sf):
    """Links and where they go on."""
    n = parts(table(spark, sf, "lineitem").count(), spark)
    e = edges(spark, sf, n)
    f = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    # links are distinct, so no row comes twice
    return e.repartition(n, "dst").join(f.repartition(n, "dst"), "dst", "left").select("dst", "src", "next")


@operator(f"WITH RECURSIVE {EDGES}, r AS (SELECT CAST(399 AS BIGINT) AS node UNION SELECT 398 UNION SELECT dst FROM r JOIN edges ON src = node) SELECT node FROM r")
def reachability(spark, sf):
    """Everything reachable from two seeds."""
    seeds = spark.range(398, 400).select(F.col("id").alias("node"))
    return G.reach(edges(spark, sf), seeds).select("node")


def _ring(spark, sf):
    li = table(spark, sf, "lineitem").where("l_linenumber = 2")
    return li.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7).alias("dst")).where("src <> dst").distinct()


_RING = "ring AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 7 AS dst FROM lineitem WHERE l_linenumber = 2 AND l_partkey <> l_suppkey * 7)"


@operator(f"WITH RECURSIVE {_RING}, c AS (SELECT src, dst FROM ring UNION SELECT c.src, r.dst FROM c JOIN ring r ON c.dst = r.src) SELECT r.src, r.dst FROM ring r WHERE EXISTS (SELECT 1 FROM c WHERE c.src = r.dst AND c.dst = r.src)")
def cycle_edges(spark, sf):
    """Links on a cycle."""
    return G.cycle_edges(_ring(spark, sf))


@operator(f"""WITH {EDGES}, l AS (SELECT src, dst, CASE WHEN (src + dst) % 3 = 0 THEN 'part' ELSE 'whole' END AS scope FROM edges),
h AS (SELECT DISTINCT l_suppkey % 10 AS q, l_partkey AS item FROM lineitem WHERE l_linenumber = 3 AND l_quantity > 40),
f AS (SELECT a.q, a.item, bool_or(scope = 'whole') AS hidden, bool_or(scope = 'part') AS demoted FROM h a JOIN l ON dst = a.item JOIN h b ON b.q = a.q AND b.item = src GROUP BY ALL)
SELECT h.q, h.item, coalesce(hidden, false) AS hidden, coalesce(demoted, false) AS demoted FROM h LEFT JOIN f USING (q, item)""")
def supersession_hide(spark, sf):
    """A link hides or demotes its target only among hits."""
    l = edges(spark, sf).withColumn("scope", F.when((F.col("src") + F.col("dst")) % 3 == 0, "part").otherwise("whole"))
    h = table(spark, sf, "lineitem").where("l_linenumber = 3 AND l_quantity > 40").select((F.col("l_suppkey") % 10).alias("q"), F.col("l_partkey").alias("item")).distinct()
    return G.supersede(h, l, ["q"])


@operator(f"WITH RECURSIVE {_PAR}, c AS (SELECT node, parent AS anc, 1 AS depth FROM par WHERE parent IS NOT NULL UNION ALL SELECT c.node, p.parent, c.depth + 1 FROM c JOIN par p ON p.node = c.anc WHERE p.parent IS NOT NULL), d AS (SELECT node, arg_max(anc, depth) AS origin, max(depth) AS hops FROM c GROUP BY node) SELECT node, origin, hops FROM d JOIN versions ON version_id = origin AND device_scope <> 'all'")
def provenance(spark, sf):
    """The first version of each chain, if it may be seen."""
    o = G.chains(parents(spark, sf)).groupBy("node").agg(F.max_by("ancestor", "depth").alias("origin"), F.max("depth").alias("hops"))
    seen = versions(spark, sf).where("device_scope <> 'all'").select(F.col("version_id").alias("origin"))
    return o.join(seen, "origin", "left_semi").select("node", "origin", "hops")


@operator(f"WITH RECURSIVE {EDGES}, r AS (SELECT src AS item, 0 AS round FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT dst, round + 1 FROM r JOIN edges ON src = item) SELECT item, max(round) AS round FROM r GROUP BY item")
def topological_order(spark, sf):
    """newer items before those they replace, by rounds; the order is that of (round, item), and no round is put through one task."""
    return G.levels(edges(spark, sf))
