"""Ranked candidate lists, their fusion by reciprocal ranks, and packing under a budget."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import prepare

K_RRF = 60
#: Most rows of a list.
LEXICAL, TRIGRAM, VECTOR, TITLE = 100, 20, 100, 20
#: Query vectors sent at once, vectors of a task and most tasks of a block, and queries and vectors that are multiplied at once.
BLOCK, TASK_ROWS, MOST_TASKS, STEP = 20_000, 16_384, 64, 2048


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def unit(v: str) -> Column:
    """The vector divided by its length."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda x, y: x + y.cast("double") * y.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / n)


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by a total order, with their rank; Spark cuts each task's rows to k before it shuffles them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """(q, v, sim, rank): the k vectors nearest to each query (q, qv), itself left out. ``vectors`` has vec_id and embedding.

    A stated query set is held against all vectors, in blocks of about BLOCK queries that are sent to all tasks one after the other. A task compares its
    vectors with a block by matrix products, STEP by STEP, and gives out what may be among its first k; those partial lists are merged, so no task holds a
    query's whole list. Vectors with a null, or of another length than the block's queries, have a null for ``sim`` and come last.
    """
    queries = queries.where("q IS NOT NULL")
    vectors = vectors.where("vec_id IS NOT NULL").select("vec_id", "embedding")
    blocks = max(1, -(-queries.count() // BLOCK))
    vectors = vectors.repartition(max(1, min(MOST_TASKS, -(-vectors.count() // TASK_ROWS))))
    block = lambda b: queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else queries
    return reduce(DataFrame.unionAll, (_cosine_block(block(b), vectors, k, digits) for b in range(blocks)))


def _cosine_block(queries: DataFrame, vectors: DataFrame, k: int, digits: int) -> DataFrame:
    spark = prepare(queries.sparkSession)
    t = queries.select("q", "qv").toArrow().combine_chunks()
    ids, lists = (t[c].combine_chunks() for c in ("q", "qv"))
    d = max(lists.value_lengths().drop_null().to_pylist(), default=0)
    shared = spark.sparkContext.broadcast((ids.to_numpy(zero_copy_only=False), *_matrix(lists, d)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x, has = shared.value
        order = np.argsort(own, kind="stable")
        own, x, has = own[order], x[order], has[order]
        parts = [_Nearest(own[i : i + STEP], x[i : i + STEP], has[i : i + STEP], k, 1.01 * 10.0**-digits) for i in range(0, len(own), STEP)]
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                piece = b.slice(at, STEP)
                v, (y, there) = piece.column(0).to_numpy(zero_copy_only=False), _matrix(piece.column(1), d)
                for p in parts:
                    p.meet(v, y, there)
        for p in parts:
            q, v, s, known = p.found()
            for at in range(0, len(q), 65_536):
                cut = slice(at, at + 65_536)
                yield pa.record_batch([pa.array(q[cut]), pa.array(v[cut]), pa.array(s[cut], mask=~known[cut])], names=["q", "v", "s"])

    kinds = queries.schema["q"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    s = vectors.mapInArrow(nearest, f"q {kinds[0]}, v {kinds[1]}, s double")
    return top_k(s.select("q", "v", F.round("s", digits).alias("sim")), ["q"], [F.col("sim").desc(), F.col("v")], k)


def _matrix(lists: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of ``d`` doubles, and which of them have that length and no null; the others are zeros."""
    at = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d)
    flat = lists.take(pa.array(at)).flatten()
    gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), d).any(axis=1)
    x, has = np.zeros((len(lists), d)), np.zeros(len(lists), bool)
    x[at] = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
    x[at[gaps]], has[at] = 0, ~gaps
    return x, has


class _Nearest:
    """For some queries, sorted by id, those of the vectors met so far that may be among the first k once products are rounded; ``slack`` is more than what rounding shifts."""

    def __init__(self, own: np.ndarray, x: np.ndarray, has: np.ndarray, k: int, slack: float):
        self.own, self.x, self.columns, self.has, self.k, self.slack = own, x, np.ascontiguousarray(x.T), has, k, slack
        self.least = np.full(len(own), -np.inf)
        self.i, self.v, self.s = np.zeros(0, np.int64), None, np.zeros(0)
        self.all, self.without = None, None

    def meet(self, v: np.ndarray, y: np.ndarray, there: np.ndarray) -> None:
        # the first ids of all, and of those without a vector: they fill up lists that have too few
        self.all, self.without = self._first(self.all, v), self._first(self.without, v[~there])
        v, y = v[there], y[there]
        if not len(v):
            return
        with np.errstate(all="ignore"):
            near = self.x @ y.T
        near[np.isnan(near)] = np.inf
        near[~self.has] = -np.inf
        lo, hi = np.searchsorted(self.own, v, "left"), np.searchsorted(self.own, v, "right")
        for j in np.flatnonzero(hi > lo):
            near[lo[j] : hi[j], j] = -np.inf  # itself
        least = self.least
        if len(v) > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(near, len(v) - self.k, axis=1)[:, len(v) - self.k])
        i, j = np.nonzero((near >= (least - self.slack)[:, None]) & (near > -np.inf))
        if len(i):
            self._add(i, v[j], self._products(i, j, np.ascontiguousarray(y.T)))

    def _products(self, i: np.ndarray, j: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Inner products as sums in the order of the components, as Spark adds them up."""
        s = np.zeros(len(i))
        with np.errstate(all="ignore"):
            for a, b in zip(self.columns, y, strict=True):
                s += a[i] * b[j]
        return s

    def _add(self, i: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        if self.v is not None:
            i, v, s = np.concatenate([self.i, i]), np.concatenate([self.v, v]), np.concatenate([self.s, s])
        none = np.isnan(s)
        key = np.where(none, np.inf, s)
        order = np.lexsort((v, -key, ~none, i))
        i, v, s, none, key = i[order], v[order], s[order], none[order], key[order]
        # of equal products of one query the first k ids are enough
        new = np.r_[True, (np.diff(i) != 0) | (key[1:] != key[:-1]) | (none[1:] != none[:-1])]
        keep = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1] < self.k
        i, v, s, key = i[keep], v[keep], s[keep], key[keep]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        last = place == self.k - 1
        self.least[i[last]] = key[last]
        keep = (place < self.k) | (key >= self.least[i] - self.slack)
        self.i, self.v, self.s = i[keep], v[keep], s[keep]

    def _first(self, ids: np.ndarray | None, more: np.ndarray) -> np.ndarray:
        return np.sort(more if ids is None else np.concatenate([ids, more]))[: self.k + 1]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(q, v, product, whether there is one) of what may be in the lists."""
        if self.all is None:
            return self.own[:0], self.own[:0], self.s[:0], np.zeros(0, bool)
        q, v, s = self.own[self.i], self.all[:0] if self.v is None else self.v, self.s
        known = np.ones(len(q), bool)
        for rows, ids in ((self.own[self.has], self.without), (self.own[~self.has], self.all)):
            a, b = np.repeat(rows, len(ids)), np.tile(ids, len(rows))
            q, v, s, known = np.r_[q, a[a != b]], np.r_[v, b[a != b]], np.r_[s, np.zeros((a != b).sum())], np.r_[known, np.zeros((a != b).sum(), bool)]
        return q, v, s, known


def pack_prefix(rows: DataFrame, by: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The longest prefix whose running cost stays within the budget: it stops at the first row that doesn't fit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def rare_terms(terms: DataFrame, df: DataFrame, n_docs: DataFrame, share: float = 0.2, least: int = 100, fallback: int = 2) -> DataFrame:
    """Terms (qid, tok) that at most ``share`` of the documents have; identifiers stay; if all are common the two rarest stay."""
    t = terms.join(df, "tok", "left").withColumn("df", F.coalesce("df", F.lit(0))).crossJoin(F.broadcast(n_docs))
    ok = (F.col("n_docs") < least) | (F.col("df") <= share * F.col("n_docs")) | F.col("tok").rlike("[_/.0-9]")
    w = Window.partitionBy("qid")
    t = t.withColumns({"ok": ok, "any": F.max(ok.cast("int")).over(w), "rn": F.row_number().over(w.orderBy("df", "tok"))})
    return t.where("ok OR (any = 0 AND rn <= %d)" % fallback).select("qid", "tok", "df")
