"""Quantiles of groups of any size: a mergeable sketch built in parts, and exact values by counting between its bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.sizes import held
from tidemark.session import stored

#: Values a level of a sketch holds, and different values between two bounds that are counted one by one.
KEEP, COUNTED = 512, 100_000


class Sketch:
    """Values with weights: level h holds values that stand for 2^h each. A full level is sorted, and every second value goes up.

    ``err`` is the most that the rank of any value can be off: each time a level is halved, by one weight of it.
    """

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.n, self.err, self.odd = 0, 0, 0

    def add(self, values: np.ndarray, level: int = 0) -> None:
        if level == 0:
            self.n += len(values)
        while level >= len(self.levels):
            self.levels.append(np.zeros(0))
        have = np.concatenate([self.levels[level], values])
        if len(have) >= 2 * KEEP:
            have.sort()
            even = len(have) // 2 * 2
            self.odd ^= 1
            self.err += 1 << level
            up, have = have[self.odd : even : 2], have[even:]
            self.levels[level] = have
            self.add(up, level + 1)
        else:
            self.levels[level] = have

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        weights = np.concatenate([np.full(len(x), 1 << h) for h, x in enumerate(self.levels)])
        return np.concatenate(self.levels), weights.astype(np.int64)


def sketch(rows: DataFrame) -> DataFrame:
    """(g, v, w, err): the sketches of each task's groups of rows (g string, v double), item by item; ``err`` stands at one item of a sketch. KEEP * log(rows) items each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Sketch] = {}
        for b in batches:
            values = pd.Series(b.column(1).to_numpy(zero_copy_only=False))
            for key, part in values.groupby(b.column(0).to_pandas(), sort=False):
                found.setdefault(key, Sketch()).add(part.to_numpy())
        for key, s in found.items():
            v, w = s.items()
            err = np.zeros(len(v), np.int64)
            err[0] = s.err
            yield pa.record_batch([pa.array([key] * len(v)), pa.array(v), pa.array(w), pa.array(err)], names=["g", "v", "w", "err"])

    return rows.select("g", "v").mapInArrow(run, "g string, v double, w long, err long")


def bounds(sketches: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, k, lo, hi) for ranks (g, k) from 1: the k-th value is above lo and at most hi; null where the sketch knows no such bound.

    Sketches merge by putting their items together, of a group what all tasks have of it and never its rows; their errors add up.
    """
    w = Window.partitionBy("g")
    upto = F.sum("w").over(w.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    s = sketches.withColumns({"upto": upto, "e": F.sum("err").over(w)}).select("g", "v", (F.col("upto") + F.col("e")).alias("most"), (F.col("upto") - F.col("e")).alias("least"))
    j = s.join(held(ranks), "g")
    return j.groupBy("g", "k").agg(F.max(F.when(F.col("most") < F.col("k"), F.col("v"))).alias("lo"), F.min(F.when(F.col("least") >= F.col("k"), F.col("v"))).alias("hi"))


def of_rank(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, k, x): the k-th smallest value of each group of rows (g, v), for ranks (g, k) from 1.

    A sketch bounds each; what lies between the bounds is counted by value, after what lies below. Where more than COUNTED different values are left, they get
    a sketch of their own.
    """
    b = held(bounds(stored(sketch(rows)), ranks))
    j = rows.join(b, "g").where(F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
    low = F.col("lo").isNotNull() & (F.col("v") <= F.col("lo"))
    below = held(j.where(low).groupBy("g", "k").agg(F.count("*").alias("below")))
    left = stored(j.where(~low).select(F.concat_ws("|", "g", "k").alias("own"), "g", "k", "v"))
    size = held(left.groupBy("own", "g", "k").agg(F.approx_count_distinct("v").alias("d"), F.count("*").alias("n")).join(rows.groupBy("g").agg(F.count("*").alias("of")), "g").join(below, ["g", "k"], "left").select("own", "g", "k", F.coalesce("below", F.lit(0)).alias("below"), ((F.col("d") > COUNTED) & (F.col("n") < F.col("of"))).alias("more")))
    c = left.join(size.where("NOT more").select("own", "below"), "own").groupBy("own", "g", "k", "below", "v").agg(F.count("*").alias("n"))
    c = c.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("own").orderBy("v")))
    out = c.where(F.col("upto") >= F.col("k")).groupBy("g", "k").agg(F.min("v").alias("x"))
    more = size.where("more")
    if more.isEmpty():
        return out
    deep = of_rank(left.join(more.select("own"), "own").select(F.col("own").alias("g"), "v"), more.select(F.col("own").alias("g"), (F.col("k") - F.col("below")).alias("k")))
    return out.unionByName(deep.withColumnRenamed("g", "own").drop("k").join(more, "own").select("g", "k", "x"))


def percentile_exact(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by.., share, disc, cont): discrete and interpolated percentiles of each group's values, nulls left out, without any task that holds or sorts a group.

    Values are taken as doubles. Groups without a value give no rows.
    """
    d = rows.where(F.col(value).isNotNull()).select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("g"), F.col(value).cast("double").alias("v"))
    n = held(d.groupBy("g").agg(F.count("*").alias("n")))
    share = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    at = lambda c: c.cast("long") + 1
    pos = F.round(F.col("share") * (F.col("n") - 1), 6)
    t = held(n.select("g", "n", share).select("g", "share", F.greatest(F.lit(1), F.ceil(F.round(F.col("share") * F.col("n"), 6))).alias("kd"), at(F.floor(pos)).alias("k0"), at(F.ceil(pos)).alias("k1"), (pos - F.floor(pos)).alias("part")))
    x = held(of_rank(d, t.select("g", F.explode(F.array("kd", "k0", "k1")).alias("k")).distinct()))
    for k in ("kd", "k0", "k1"):
        t = t.join(x.select("g", F.col("k").alias(k), F.col("x").alias(f"x{k}")), ["g", k])
    named = held(rows.select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("__g"), *by).distinct())
    t = t.select(F.col("g").alias("__g"), "share", F.col("xkd").alias("disc"), (F.col("xk0") + (F.col("xk1") - F.col("xk0")) * F.col("part")).alias("cont"))
    return named.join(t, "__g").select(*by, "share", "disc", "cont")
