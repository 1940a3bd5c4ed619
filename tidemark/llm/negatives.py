"""Hard negatives by segment summaries: means and deviations of vector segments bound inner products, level by level, before any is counted exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut, stored

#: Anchors are rows whose id this divides; relabelled are those whose id the other divides. Components are floors of SCALE times the value.
EVERY, RELABEL, LABELS, SCALE = 100, 7, 10, 256
#: Positives of an anchor, negatives of an anchor and positive, and the share of the positive's score, in hundredths, between which a negative's lies.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Components of a segment at each level of refinement.
WIDTHS = (64, 16, 4)
#: Anchors held against all rows in one pass, and rows of a step within a task.
ANCHORS, STEP = 2000, 2048
#: Pairs are scored in pieces of this many.
PAIRS = 1 << 18
_MOST = (1 << 63) - 1


class Block:
    """Vectors with the mean and the deviation of each segment at each level; shorter vectors are zero at their end."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, summaries: tuple[list[np.ndarray], list[np.ndarray]] | None = None) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.means, self.devs = summaries or summarise(vectors)


def summarise(vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(means, deviations): for each level an array of rows and segments."""
    n, d = vectors.shape
    whole = np.zeros((n, max(1, -(-d // WIDTHS[0])) * WIDTHS[0]))
    whole[:, :d] = vectors
    parts = [whole.reshape(n, whole.shape[1] // w, w) for w in WIDTHS]
    return [p.mean(axis=2) for p in parts], [p.std(axis=2) for p in parts]


def _padded(a: np.ndarray, n: int) -> np.ndarray:
    return a if a.shape[1] >= n else np.concatenate([a, np.zeros((len(a), n - a.shape[1]), a.dtype)], axis=1)


def bounds(rows: Block, anchors: Block, level: int, i: np.ndarray | None = None, j: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the inner products can be, of all rows and anchors or of the pairs (i, j).

    Over a segment of w components the product is w times the means' product, give or take at most w times the deviations' product. A slack covers what
    floating point loses.
    """
    w = float(WIDTHS[level])
    n = max(rows.means[level].shape[1], anchors.means[level].shape[1])
    a, b, c, d = (_padded(x[level], n) for x in (rows.means, anchors.means, rows.devs, anchors.devs))
    if i is None:
        middle, reach, size = w * (a @ b.T), w * (c @ d.T), w * (np.abs(a) @ np.abs(b).T)
    else:
        x, y = a[i], b[j]
        middle, reach, size = w * np.einsum("ij,ij->i", x, y), w * np.einsum("ij,ij->i", c[i], d[j]), w * np.einsum("ij,ij->i", np.abs(x), np.abs(y))
    reach = reach + 1e-9 * (size + reach) + 0.25
    return middle - reach, middle + reach


def products(rows: Block, anchors: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs: in doubles where none can pass 2^53, else in whole numbers of any size, held at the ends of a long."""
    n = max(rows.vectors.shape[1], anchors.vectors.shape[1])
    a, b = _padded(rows.vectors, n), _padded(anchors.vectors, n)
    top = lambda x: max(float(x.max(initial=0)), -float(x.min(initial=0)))
    exact = top(a) * top(b) * n < 1 << 53
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), PAIRS):
        x, y = a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]
        out[k : k + PAIRS] = np.einsum("ij,ij->i", x, y).astype(np.int64) if exact else [max(-_MOST - 1, min(_MOST, sum(int(p) * int(q) for p, q in zip(u, v, strict=True)))) for u, v in zip(x, y, strict=True)]
    return out


def survivors(rows: Block, anchors: Block, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of allowed rows and anchors whose bounds at no level leave out every score from least[j] to most[j]."""
    lo, hi = bounds(rows, anchors, 0)
    i, j = np.nonzero(allowed & (hi >= least) & (lo <= most))
    for level in range(1, len(WIDTHS)):
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            lo, hi = bounds(rows, anchors, level, x, y)
            keep[k : k + PAIRS] = (hi >= least[y]) & (lo <= most[y])
        i, j = i[keep], j[keep]
    return i, j


class Best:
    """The k highest scores of each key so far, ties by smaller id."""

    def __init__(self, keys: int, k: int) -> None:
        self.n, self.k = keys, k
        self.key, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(keys, -np.inf)  # a score below this is not among the best of its key

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(key):
            return
        key, ids, score = np.r_[self.key, key], np.r_[self.id, ids], np.r_[self.score, score]
        order = np.lexsort((ids, ~score, key))  # ~score falls as the score grows, without overflow
        key, ids, score = key[order], ids[order], score[order]
        first = np.searchsorted(key, key)
        place = np.arange(len(key)) - first
        keep = place < self.k
        last = place == self.k - 1
        self.floor[key[last]] = score[last].astype(np.float64)
        self.key, self.id, self.score = key[keep], ids[keep], score[keep]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The rows of stored batches in steps of STEP."""
    for b in batches:
        for k in range(0, b.num_rows, STEP):
            p = b.slice(k, STEP)
            means, devs = ([_matrix(p.column(f"{c}{w}")) for w in WIDTHS] for c in ("mean", "dev"))
            yield Block(p.column("vec_id").to_numpy(zero_copy_only=False), p.column("label").to_numpy(zero_copy_only=False), _matrix(p.column("v")), (means, devs))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of lists; where they differ in length a zero stands behind shorter ones."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    size = np.diff(ends)
    n = int(size.max(initial=0))
    if (size == n).all():
        return flat.reshape(len(size), n)
    out = np.zeros((len(size), n), flat.dtype)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1], size)] = flat
    return out


def prepare(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v, mean64, mean16, mean4, dev64, ...), stored: rows that take part, with whole components and the summaries of their segments at each level.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Of rows that share an id the one with the smallest label,
    then vector, takes part. Components beyond a long stand at its end.
    """
    d = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.transform(f"`{vector}`", lambda x: x.cast("double")).alias("x"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = d.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(F.forall("x", fine))
    own = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    d = d.select("vec_id", own.alias("label"), F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))
    again = cut(d.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    if not again.isEmpty():
        one = d.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
        d = d.join(again, "vec_id", "left_anti").unionByName(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                p = b.slice(k, STEP)
                means, devs = summarise(_matrix(p.column("v")))
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.record_batch([*p.columns, *map(lists, means + devs)], names=["vec_id", "label", "v", *levels])

    levels = [f"{c}{w}" for c in ("mean", "dev") for w in WIDTHS]
    return stored(d.mapInArrow(run, "vec_id long, label long, v array<long>, " + ", ".join(f"{c} array<double>" for c in levels)))


def _collected(rows: DataFrame) -> Block:
    """A block of anchors, at most about ANCHORS."""
    t = rows.select("vec_id", "label", "v").orderBy("vec_id").toArrow().combine_chunks()
    col = lambda c: t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type)
    return Block(col("vec_id").to_numpy(zero_copy_only=False), col("label").to_numpy(zero_copy_only=False), _matrix(col("v")) if t.num_rows else np.zeros((0, 0), np.int64))


def positives(rows: DataFrame, anchors: Block, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, positive_id, positive_score, place): the first k other rows with the anchor's label. Each task keeps k an anchor, and those are merged."""
    at = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = at.value
        best = Best(len(a.ids), k)
        for r in _blocks(batches):
            allowed = (r.labels[:, None] == a.labels) & (r.ids[:, None] != a.ids)
            least = best.floor - 1e-9 * np.abs(np.where(np.isfinite(best.floor), best.floor, 0))
            i, j = survivors(r, a, allowed, least, np.full(len(a.ids), np.inf))
            best.add(j, r.ids[i], products(r, a, i, j))
        yield pa.record_batch([pa.array(a.ids[best.key]), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "positive_id", "positive_score"])

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def negatives(rows: DataFrame, anchors: Block, found: list[tuple[int, int, int]], k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, negative_id, positive_score, negative_score, rank) for each (anchor, positive, score) of ``found``, in any order.

    A row of another label is a negative if low * positive_score <= 100 * negative_score <= high * positive_score. An anchor's bounds are tested against
    the widest of its bands, from which what is below the k-th best of all of them is cut as a task goes on.
    """
    place = {int(v): n for n, v in enumerate(anchors.ids)}
    anchor = np.array([place[a] for a, _, _ in found], np.int64)
    other, score = (np.array([x[c] for x in found], np.int64) for c in (1, 2))
    order = np.argsort(anchor, kind="stable")
    own = (anchor[order], other[order], score[order])
    at = rows.sparkSession.sparkContext.broadcast((anchors, *own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, anchor, other, score = at.value
        n = len(a.ids)
        best = Best(len(anchor), k)
        # band ends as whole numbers: from the ceiling of low / 100 of the score to the floor of high / 100 of it
        lo = np.array([-(-low * s // 100) for s in score.tolist()], object)
        hi = np.array([high * s // 100 for s in score.tolist()], object)
        lo, hi = (np.clip(x, -_MOST - 1, _MOST).astype(np.int64) for x in (lo, hi))
        first, count = np.searchsorted(anchor, np.arange(n)), np.bincount(anchor, minlength=n)
        most = np.full(n, -np.inf)
        np.maximum.at(most, anchor, hi + 1e-9 * np.abs(hi))
        for r in _blocks(batches):
            floor = np.maximum(lo, best.floor)
            least = np.full(n, np.inf)
            np.minimum.at(least, anchor, floor - 1e-9 * np.abs(floor))
            i, j = survivors(r, a, r.labels[:, None] != a.labels, least, most)
            for p in range(0, len(i), PAIRS):
                x, y = i[p : p + PAIRS], j[p : p + PAIRS]
                s = products(r, a, x, y)
                pair = np.repeat(np.arange(len(x)), count[y])
                slot = np.repeat(first[y] - np.r_[0, np.cumsum(count[y])[:-1]], count[y]) + np.arange(len(pair))
                inside = (s[pair] >= lo[slot]) & (s[pair] <= hi[slot]) & (s[pair] >= best.floor[slot])
                pair, slot = pair[inside], slot[inside]
                best.add(slot, r.ids[x[pair]], s[pair])
        yield pa.record_batch([pa.array(a.ids[anchor[best.key]]), pa.array(other[best.key]), pa.array(best.id), pa.array(score[best.key]), pa.array(best.score)], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    out = rows.mapInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows``.

    Anchors are a stated query set: blocks of about ANCHORS of them, with their positives, go to all tasks one after the other, and each is held against
    all rows where those lie, so that no row is shuffled and no label is one group. A task keeps only the best of each anchor, or anchor and positive; the
    windows that merge them get at most so many from each task. Vectors of different lengths are compared as if the shorter one went on in zeros, an empty
    one scores 0; scores beyond a long stand at its end. An anchor without a positive, or with no row in the band, gives no rows; nor does an empty table.
    """
    d = prepare(rows, id_col, vector, label)
    anchors = d.where(F.col("vec_id") % every == 0)
    blocks = -(-anchors.count() // ANCHORS)
    out = []
    for b in range(max(1, blocks)):
        block = _collected(anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))) == b))
        found = [tuple(x) for x in positives(d, block).select("anchor_id", "positive_id", "positive_score").collect()]
        part = negatives(d, block, found).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out.append(stored(part) if blocks > 1 else part)
    return reduce(DataFrame.unionAll, out)


#: The same by inner products of all anchors and rows.
SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
