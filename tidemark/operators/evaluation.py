"""Evaluation aggregates: rank metrics, AUC, thresholds, exact McNemar, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percentile_disc(value: str, share: float) -> Column:
    """Nearest-rank percentile."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def run_stats(rows: DataFrame, by: list[str], rep: str, score: str, latency: str, cost: str) -> DataFrame:
    """n, mean, correct share, least mean of a repetition, spread of those means, latency percentiles, and cost for each correct row."""
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(score).alias("mean"),
        F.avg(F.when(F.col(score) >= 0.5, 1.0).otherwise(0.0)).alias("correct"),
        percentile_disc(latency, 0.5).alias("p50"),
        percentile_disc(latency, 0.95).alias("p95"),
        F.sum(cost).alias("cost"),
        F.count_if(F.col(score) >= 0.5).alias("n_correct"),
    )
    r = rows.groupBy(*by, rep).agg(F.avg(score).alias("m")).groupBy(*by).agg(F.min("m").alias("worst_rep"), F.stddev_pop("m").alias("rep_sd"))
    return g.join(r, by).withColumn("cost_per_correct", F.col("cost") / F.nullif("n_correct", F.lit(0)))


def auc(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Chance that a positive scores above a negative, ties half, from average ranks."""
    ties = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    t = ties.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    a = t.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return a.where("p > 0 AND q > 0").select(*by, "p", "q", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def best_threshold(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The score from which on calling a row positive gives the largest Youden index; the lowest of equals. Running counts over distinct scores."""
    t = rows.groupBy(F.col(score).alias("t")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    total = t.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    # a row for each distinct score: one task carries running counts, not rows
    w = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = t.withColumns({"cp": F.sum("p").over(w), "cq": F.sum("q").over(w)}).crossJoin(F.broadcast(total)).withColumn("youden", F.col("cp") / F.col("sp") - F.col("cq") / F.col("sq"))
    return j.orderBy(F.col("youden").desc(), "t").limit(1).select(F.col("t").alias("threshold"), "youden")


def rank_metrics(ranked: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """hit@1, @3, @5, @10 and MRR@10; rank is null for a miss."""
    hit = lambda k: F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), hit(1), hit(3), hit(5), hit(10), F.avg(F.when(F.col(rank) <= 10, 1.0 / F.col(rank)).otherwise(0.0)).alias("mrr"))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts: min(1, 2 * P(X <= min(b, c))), X binomial of b + c at a half, by a running product."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * (n - i + 1) / i).alias("term"), (a["sum"] + a["term"] * (n - i + 1) / i).alias("sum"))
    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, step, lambda a: a["sum"])).otherwise(F.pow(F.lit(0.5), n))
    return F.least(F.lit(1.0), 2 * tail)
