"""Bi-temporal row sets: corrections, closes, as-of joins and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.predicates import overlaps, since_until


def survivors(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """What is left of each row's valid time outside [start, end): none, one or two segments, as valid_from and valid_to."""
    seg = lambda a, b: F.struct(a.alias("valid_from"), b.alias("valid_to"))
    left = F.when(F.col("valid_from") < start, seg(F.col("valid_from"), F.when(F.col("valid_to").isNull() | (F.col("valid_to") > start), start).otherwise(F.col("valid_to"))))
    right = F.when(end.isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > end)), seg(F.greatest(F.col("valid_from"), end), F.col("valid_to")))
    parts = F.filter(F.array(left, right), lambda s: s.isNotNull())
    other = [c for c in rows.columns if c not in ("valid_from", "valid_to")]
    return rows.select(*other, F.explode(parts).alias("seg")).select(*other, "seg.*")


def correct(rows: DataFrame, fixes: DataFrame, at: Column) -> DataFrame:
    """The new row set after fixes (logical_id, fix_from, fix_to, fix_kind): untouched rows, closed rows, survivors and replacements, by ``op``.

    Every open row that a fix overlaps is superseded at ``at``; its valid time outside the fix goes on as new rows.
    """
    open_ = rows.where("superseded_at IS NULL")
    hit = overlaps((F.col("valid_from"), F.col("valid_to")), (F.col("fix_from"), F.col("fix_to")))
    touched = open_.join(fixes, "logical_id").where(hit)
    ids = touched.select("version_id").distinct()
    same = rows.join(ids, "version_id", "left_anti").withColumn("op", F.lit("kept"))
    closed = rows.join(ids, "version_id", "left_semi").withColumn("superseded_at", at).withColumn("op", F.lit("closed"))
    left = survivors(touched, F.col("fix_from"), F.col("fix_to")).withColumn("recorded_at", at).withColumn("op", F.lit("survivor"))
    new = touched.groupBy("logical_id", "fix_from", "fix_to", "fix_kind").agg(F.max("version_id").alias("version_id"))
    new = new.select("version_id", "logical_id", F.col("fix_from").alias("valid_from"), F.col("fix_to").alias("valid_to"), F.col("fix_kind").alias("kind"), at.alias("recorded_at"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"), F.lit("replacement").alias("op"))
    names = ["version_id", "logical_id", "valid_from", "valid_to", "kind", "recorded_at", "superseded_at", "op"]
    return same.select(names).unionAll(closed.select(names)).unionAll(left.select(names)).unionAll(new.select(names))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """Each left row with the right row of its key that is valid at its instant. Segments of a key don't overlap, so an equi-join with a range filter is enough."""
    return left.join(right, key).where(since_until(F.col("valid_from"), F.col("valid_to"), F.col(at)))


def newest_before(left: DataFrame, right: DataFrame, key: str, left_id: str, at: str, since: str) -> DataFrame:
    """Each left row with the newest right row at or before its instant, or none: union, order and carry forward, without pairs.

    ``right`` columns come back under their names; ``left`` must not have them.
    """
    extra = [c for c in right.columns if c != key]
    lcols = left.columns
    a = left.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*lcols).alias("__l"), F.lit(None).cast(right.select(F.struct(*extra).alias("x")).schema["x"].dataType).alias("__r"))
    b = right.select(F.col(key), F.col(since).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*lcols).alias("x")).schema["x"].dataType).alias("__l"), F.struct(*extra).alias("__r"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__l.*", *(F.col(f"__r.{c}").alias(c) for c in extra))


def overlap_violations(rows: DataFrame) -> DataFrame:
    """Pairs of rows of a logical id that overlap on both time axes; a sound table has none."""
    a, b = rows.alias("a"), rows.alias("b")
    iv = lambda x, s, e: (F.col(f"{x}.{s}"), F.col(f"{x}.{e}"))
    cond = (F.col("a.logical_id") == F.col("b.logical_id")) & (F.col("a.version_id") < F.col("b.version_id"))
    cond = cond & overlaps(iv("a", "valid_from", "valid_to"), iv("b", "valid_from", "valid_to")) & overlaps(iv("a", "recorded_at", "superseded_at"), iv("b", "recorded_at", "superseded_at"))
    return a.join(b, cond).select(F.col("a.logical_id").alias("logical_id"), F.col("a.version_id").alias("first_id"), F.col("b.version_id").alias("second_id"))
