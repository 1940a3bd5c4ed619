"""Links written in bulk: proposals judged and applied together, taken back together, and links revised over an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.predicates import first_reason, overlaps
from tidemark.operators.graph import cycle_edges
from tidemark.session import stored

#: Stands for the end of what is open.
_FAR = "9999-12-31"


def judge(proposals: DataFrame, live: DataFrame, heads: DataFrame, least: float = 0.0) -> DataFrame:
    """(id, src, dst, outcome, valid_from) for each of ``proposals`` (id, src, dst, src_version, dst_version, confidence, status).

    Outcomes, the first that holds: ``not-proposed``; ``no-endpoint`` (a null end); ``self``; ``low`` confidence (null counts as 0); ``duplicate`` of the pair's most confident
    proposal, least id of equals; ``both-directions``; ``cycle`` of what is left; ``linked`` already in ``live`` (src, dst), either way round; ``live-cycle`` with live links;
    ``stale``, where an end's head in ``heads`` (item, version, valid_from) isn't the version that was judged; else ``applied``, from the later of its heads' instants on.
    An item has one head; ids are distinct. A pair that is proposed very often is pre-aggregated and met by an equi-join.
    """
    why = first_reason((~F.col("status").eqNullSafe("proposed"), "not-proposed"), (F.col("src").isNull() | F.col("dst").isNull(), "no-endpoint"), (F.col("src") == F.col("dst"), "self"), (F.coalesce("confidence", F.lit(0.0)) < least, "low"))
    p = proposals.select("id", "src", "dst", "src_version", "dst_version", F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"), why.alias("why"))
    best = stored(p.where("why IS NULL").groupBy("src", "dst").agg(F.max_by(F.struct("id", "src_version", "dst_version"), F.struct(F.col("confidence"), -F.col("id"))).alias("b")))
    back = best.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one_way = stored(best.join(back, ["src", "dst"], "left_anti").select("src", "dst"))
    flag = lambda rows, name: rows.select("src", "dst").distinct().withColumn(name, F.lit(True))
    cyclic = flag(cycle_edges(one_way, apart=True), "cyclic")
    pairs = stored(live.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    either = flag(pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "linked")
    fresh = stored(one_way.join(cyclic, ["src", "dst"], "left_anti").join(either, ["src", "dst"], "left_anti"))
    with_live = flag(cycle_edges(fresh.unionAll(pairs), apart=True).join(fresh, ["src", "dst"], "left_semi"), "live_cycle")
    h = heads.select(F.col("item"), F.col("version"), "valid_from")
    of = lambda end: h.select(F.col("item").alias(end), F.col("version").alias(f"{end}_head"), F.col("valid_from").alias(f"{end}_from"))
    d = best.join(flag(back, "both"), ["src", "dst"], "left").join(cyclic, ["src", "dst"], "left").join(either, ["src", "dst"], "left").join(with_live, ["src", "dst"], "left")
    d = d.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    fits = (F.col("src_head").eqNullSafe(F.col("b.src_version"))) & (F.col("dst_head").eqNullSafe(F.col("b.dst_version"))) & F.col("src_head").isNotNull() & F.col("dst_head").isNotNull()
    verdict = F.coalesce(first_reason((F.col("both"), "both-directions"), (F.col("cyclic"), "cycle"), (F.col("linked"), "linked"), (F.col("live_cycle"), "live-cycle"), (~fits, "stale")), F.lit("applied"))
    d = d.select("src", "dst", F.col("b.id").alias("best"), verdict.alias("verdict"), F.greatest("src_from", "dst_from").alias("from"))
    own = F.when(F.col("why").isNotNull(), F.col("why")).when(F.col("best") != F.col("id"), "duplicate").otherwise(F.col("verdict"))
    out = p.join(d, ["src", "dst"], "left").withColumn("outcome", own)
    return out.select("id", "src", "dst", "outcome", F.when(F.col("outcome") == "applied", F.col("from")).alias("valid_from"))


def applied(links: DataFrame, judged: DataFrame, origin: str, at: Column) -> DataFrame:
    """``links`` (link_id, src, dst, origin, valid_from, recorded_at, superseded_at) and a row for each applied proposal, its id as link_id."""
    new = judged.where("outcome = 'applied'").select(F.col("id").alias("link_id"), "src", "dst", F.lit(origin).alias("origin"), "valid_from", at.alias("recorded_at"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"))
    return links.select(new.columns).unionAll(new)


def reverted(links: DataFrame, origin: str, at: Column) -> DataFrame:
    """``links`` with every open row of ``origin`` superseded at ``at``; what was closed before stays as it is, so a second revert changes nothing."""
    mine = F.col("origin").eqNullSafe(origin) & F.col("superseded_at").isNull()
    return links.withColumn("superseded_at", F.when(mine, at).otherwise(F.col("superseded_at")))


def revised(links: DataFrame, fixes: DataFrame, targets: DataFrame, at: Column) -> DataFrame:
    """All rows of ``links`` (link_id, src, dst, valid_from, valid_to, recorded_at, superseded_at) after ``fixes`` (src, fix_from, fix_to) set the links from ``src``; ``op`` says what each is.

    ``kept`` as it was; ``closed`` at ``at``, if it was open and a fix of its source overlaps it; ``survivor``: a part of a closed link that no fix covers, with the link's id;
    ``inserted``: a row for each fix and each of ``targets`` (src, dst), without an id. A null end is open. Fixes of a source may overlap, also repeatedly; fixes without length
    and with null starts do nothing. Links are told by link_id.
    """
    far = F.lit(_FAR).cast("timestamp_ntz")
    end = lambda c: F.coalesce(c, far)
    f = fixes.where(F.col("fix_from") < end(F.col("fix_to"))).select("src", "fix_from", end(F.col("fix_to")).alias("fix_to"))
    hit = overlaps((F.col("valid_from"), end(F.col("valid_to"))), (F.col("fix_from"), F.col("fix_to")))
    met = stored(links.where("superseded_at IS NULL").join(f, "src").where(hit))
    ids = met.select("link_id").distinct()
    names = ["link_id", "src", "dst", "valid_from", "valid_to", "recorded_at", "superseded_at", "op"]
    none = F.lit(None).cast("timestamp_ntz")
    closed = links.join(ids, "link_id", "left_semi").withColumn("superseded_at", F.coalesce("superseded_at", at)).withColumn("op", F.lit("closed"))
    kept = links.join(ids, "link_id", "left_anti").withColumn("op", F.lit("kept"))
    line = Window.partitionBy("link_id").orderBy("fix_from", "fix_to")  # the fixes of one link
    before = F.greatest("valid_from", F.max("fix_to").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    gaps = met.select("link_id", "src", "dst", before.alias("a"), F.col("fix_from").alias("b"))
    last = met.groupBy("link_id", "src", "dst", "valid_to").agg(F.max("fix_to").alias("a")).select("link_id", "src", "dst", "a", end(F.col("valid_to")).alias("b"))
    left = gaps.unionAll(last).where("a < b").select("link_id", "src", "dst", F.col("a").alias("valid_from"), F.nullif(F.col("b"), far).alias("valid_to"), at.alias("recorded_at"), none.alias("superseded_at"), F.lit("survivor").alias("op"))
    id_type = links.schema["link_id"].dataType
    new = f.distinct().join(targets.select("src", "dst").distinct(), "src").select(F.lit(None).cast(id_type).alias("link_id"), "src", "dst", F.col("fix_from").alias("valid_from"), F.nullif(F.col("fix_to"), far).alias("valid_to"), at.alias("recorded_at"), none.alias("superseded_at"), F.lit("inserted").alias("op"))
    return kept.select(names).unionAll(closed.select(names)).unionAll(left.select(names)).unionAll(new.select(names))
