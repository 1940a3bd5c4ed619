"""Reachability, cycles and supersession over link tables, by frontier joins that end when nothing new is found."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import counted, cut, stored


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): every node reachable from ``seeds`` (node) over ``edges`` (src, dst), with its least depth. Ends also on cycles; ``most`` steps are an error, if given."""
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in count(1) if most is None else range(1, most + 1):
        nxt = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = stored(seen.unionAll(front))
    raise RuntimeError(f"not ended after {most} steps")


def trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges left when nodes without an edge in or without one out are taken away until there are none, and their number: no edge on a cycle is lost. ``edges`` are stored."""
    live, n, m = edges, None, None
    while m != 0 and (n is None or m != n):
        n = m
        starts, ends = live.select(F.col("src").alias("dst")).distinct(), live.select(F.col("dst").alias("src")).distinct()
        live, seen = counted(live.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"), n=F.count("*"))
        m = seen["n"]
    return live, m


def _classes(edges: DataFrame) -> DataFrame:
    """(node, up, down): the largest node that reaches each node and the largest that it reaches, itself included; only nodes with a label that has just grown send it on."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("fwd")).unionAll(edges.select("dst", "src", F.lit(False)))
    labels = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.col("node").alias("up"), F.col("node").alias("down"))
    grown = labels
    while True:
        sent = grown.join(both, grown.node == both.a).groupBy(F.col("b").alias("node")).agg(F.max(F.when(F.col("fwd"), F.col("up"))).alias("u"), F.max(F.when(~F.col("fwd"), F.col("down"))).alias("d"))
        grew = F.coalesce(F.col("u") > F.col("up"), F.lit(False)) | F.coalesce(F.col("d") > F.col("down"), F.lit(False))
        nxt = labels.select("node", "up", "down").join(sent, "node", "left").select("node", F.greatest("up", "u").alias("up"), F.greatest("down", "d").alias("down"), grew.alias("grew"))
        labels, seen = counted(nxt, n=F.count_if("grew"))
        if not seen["n"]:
            return labels.select("node", "up", "down")
        grown = labels.where("grew").select("node", "up", "down")


def cycle_edges(edges: DataFrame, apart: bool = False) -> DataFrame:
    """Edges (src, dst) that lie on a cycle, by colouring in rounds of joins: memory follows the edges, never the pairs with a path.

    Each node takes the largest node that reaches it and the largest that it reaches. Where both are one, the node is on that one's component, whose edges are given
    back; the rest goes on without them and without edges between nodes with other labels. The largest node's component is found each time. A null end lies on no
    cycle; repeated edges come back once. ``apart``: the edges are stored, distinct and without nulls, and are not told apart again.
    """
    if not apart:
        edges = stored(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    found, (live, n) = edges.where("src = dst"), trim(edges.where("src <> dst"))
    for k in count(1):
        if not n:
            return found
        labels = _classes(live)
        of = lambda end: labels.select(F.col("node").alias(end), F.struct("up", "down").alias(f"{end}_class"))  # noqa: B023, E731
        met = live.join(of("src"), "src").join(of("dst"), "dst").where("src_class = dst_class")
        met, seen = counted(met.select("src", "dst", (F.col("src_class.up") == F.col("src_class.down")).alias("cyclic")), n=F.count_if(F.expr("NOT cyclic")))
        found = found.unionAll(met.where("cyclic").select("src", "dst"))
        if k % 16 == 0:
            found = stored(found)  # else the plan would grow with each component
        live, n = trim(met.where("NOT cyclic").select("src", "dst")) if seen["n"] else (met, 0)


def levels(edges: DataFrame) -> DataFrame:
    """(item, round): Kahn's order by rounds over distinct edges (src, dst): a round holds the items all of whose predecessors stand in earlier ones.

    Items on a cycle or behind one have no round and come last. A round is a join of its items with the edges, so a level of any size is ordered without
    a queue in one task.
    """
    edges = stored(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    need = edges.select(F.col("src").alias("item"), F.lit(0).alias("n")).unionAll(edges.select("dst", F.lit(1))).groupBy("item").agg(F.sum("n").alias("need"))
    state = stored(need.withColumn("round", F.when(F.col("need") == 0, 0)))
    for k in count():
        placed = state.where(F.col("round") == k)
        if placed.isEmpty():
            return state.select("item", "round")
        met = placed.join(edges, placed.item == edges.src).groupBy(F.col("dst").alias("item")).agg(F.count("*").alias("met"))
        left = F.col("need") - F.coalesce("met", F.lit(0))
        state = stored(state.join(met, "item", "left").select("item", left.alias("need"), F.coalesce("round", F.when(left == 0, k + 1)).alias("round")))


def chains(parents: DataFrame, most: int = 64) -> DataFrame:
    """(node, ancestor, depth): all ancestors of nodes with one parent each (node, parent), by pointer doubling; parents have lower ids."""
    p = cut(parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    step, total = p, p
    for _ in range(most):
        # step holds the ancestors at depths up to 2^k; those beyond are found from the end of each
        a, b = step.alias("a"), step.alias("b")
        top = step.agg(F.max("depth")).first()[0]
        if top is None:
            return total
        ends = a.where(F.col("a.depth") == top)
        longer = cut(ends.join(b, F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth")))
        if longer.isEmpty():
            return total
        total = stored(total.unionAll(longer))
        step = total
    raise RuntimeError("chains are too long")


def supersede(hits: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Hits (by.., item, rank) with ``hidden`` where a whole-item link comes from another hit of the group, and ``demoted`` where a part link does.

    links: src, dst, scope ('whole' or 'part'). A link counts only if both ends are hits.
    """
    src = hits.select(*by, F.col("item").alias("src"))
    live = links.join(src, "src").select(*by, F.col("dst").alias("item"), "scope")
    flags = live.groupBy(*by, "item").agg(F.bool_or(F.col("scope") == "whole").alias("h"), F.bool_or(F.col("scope") == "part").alias("d"))
    out = hits.join(flags, [*by, "item"], "left")
    return out.select(*hits.columns, F.coalesce("h", F.lit(False)).alias("hidden"), F.coalesce("d", F.lit(False)).alias("demoted"))
