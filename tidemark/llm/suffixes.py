"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Every window of WINDOW bytes has an anchor, its least K-byte hash, leftmost of equals. Equal windows have equal anchors, so only windows of
one anchor are compared. Consecutive windows with the anchor at one place form a run; runs with equal bytes are settled by their hashes: all but
the first are removed. The first ones of anchors that have several runs are sorted as suffixes. Runs of an anchor that very many texts hold are
cut by content first: windows with the anchor at nearly the same place, and with the same bytes in what all windows of such a part share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.small import sized
from tidemark.session import cut, stored

WINDOW, K = 100, 32
NO_ID = -(2**63)
#: Bytes hashed at once, and the bits of a key that hold a place in them (in every batch, so that a window has the same anchor in all).
_BATCH, _PLACE_BITS = 4 << 20, np.uint64(32)
#: One document in SAMPLE shows which anchors are hot: those with HOT runs in the sample. Their equal runs are found in SALTS tasks first.
SAMPLE, HOT, SALTS = 32, 64, 32
#: Windows of a part of a hot run; parts that share a node with more than NODE_MAX different ones are cut into single windows.
PART, NODE_MAX = 8, 2_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    name = str(base)
    if len(_POWERS.get(name, ())) < n:
        with np.errstate(over="ignore"):
            _POWERS[name] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, 1 << 16), base, np.uint64)], dtype=np.uint64)
    return _POWERS[name]


class PrefixHash:
    """Polynomial hashes modulo 2^64 of all prefixes of a byte array; equal strings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        p = _powers(_BASE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=self.sums[1:])
        self.back = _powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _anchored(texts: list[bytes], joined: bytes) -> tuple[np.ndarray, ...]:
    """(text, start, windows, place of the anchor in the text, anchor, second hash) of every run of windows of the texts."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(joined) < WINDOW:
        return none
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(joined, np.uint8)
    h = PrefixHash(data)
    kmers = len(data) - K + 1
    gram = _mixed(((h.sums[K:] - h.sums[:-K])[:kmers]) * h.back[:kmers])
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    key = (gram & ~low) | np.arange(kmers, dtype=np.uint64)
    span = WINDOW - K + 1
    m, size = key, 1
    while 2 * size <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[: len(m) - (span - size)], m[span - size :]) if span > size else m
    # windows that lie in one text
    first = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    if not len(text):
        return none
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    place = (m[at] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    windows = np.diff(np.r_[new, len(text)])
    begin, base = at[new], first[text[new]]
    second = _mixed(h.of(begin, windows + (WINDOW - 1))) >> np.uint64(33)
    return text[new], begin - base, windows, place[new] - base, gram[place[new]].view(np.int64), second.astype(np.int64)


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, digest, second hash) of every run of windows of the texts, which hold _BATCH bytes or so together."""
    joined = b"".join(texts)
    text, start, windows, _, anchor, second = _anchored(texts, joined)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = start + (np.cumsum(sizes) - sizes)[text]
    view = memoryview(joined)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[b : b + n]) for b, n in zip(begin.tolist(), (windows + WINDOW - 1).tolist(), strict=True)), np.uint64, len(begin))
    return text, start, windows, anchor, digest.view(np.int64), second


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, n = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
        ids.append(i)
        texts.append(raw)
        n += len(raw)
        if n >= _BATCH:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


_RUN = "anchor long, digest long, doc_id long, start int, windows int, second int"


def _all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in _parts(batch):
            text, start, windows, anchor, digest, second = runs(texts)
            columns = [anchor, digest, np.array(ids, np.int64)[text], start, windows, second]
            yield pa.record_batch([pa.array(c, pa.int64()) if k < 3 else pa.array(c, pa.int32()) for k, c in enumerate(columns)], names=["anchor", "digest", "doc_id", "start", "windows", "second"])


def _parts_of_runs(size: int):
    """Runs (node, doc_id, start, windows, bytes) -> parts (node, a, b, doc_id, start, windows, bytes) of ``size`` windows at most.

    A part holds the windows whose anchor stands at places of one block of ``size``. Equal windows have their anchor at the same place and so come into
    parts of one block; those hold the bytes that all windows of the part share, which name the node. a and b are the hash of the part's bytes.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, doc, begin = (batch.column(k).to_numpy() for k in range(3))
            raw = batch.column(4).to_pylist()
            rows = []
            text, start, windows, place, _, _ = _anchored(raw, b"".join(raw))
            run = np.repeat(np.arange(len(text)), windows)
            step = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
            block = (place[run] - step) // size
            edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (run[1:] != run[:-1])]) if len(run) else np.zeros(0, np.int64)
            shared = place[run[edge]] - block[edge] * size  # where the bytes begin that all windows of the block hold
            for i, s, n, k, c in zip(text[run[edge]].tolist(), step[edge].tolist(), np.diff(np.r_[edge, len(run)]).tolist(), block[edge].tolist(), shared.tolist(), strict=True):
                own = raw[i][s : s + n + WINDOW - 1]
                d = xxhash.xxh3_128_digest(own)
                name = xxhash.xxh3_64_intdigest(raw[i][c : c + WINDOW - size + 1], seed=(int(node[i]) + k) % 2**64)
                rows.append((name - 2**63, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), int(doc[i]), int(begin[i]) + s, n, own))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["node", "a", "b", "doc_id", "start", "windows", "bytes"])

    return cut_up


_PART_ROW = "node long, a long, b long, doc_id long, start int, windows int, bytes binary"


class SuffixSort:
    """Windows of a byte array sorted by their WINDOW bytes, groups apart, by a merge sort that compares two suffixes by their common extension.

    The extension is found by binary search on prefix hashes. All merges of a level, of all groups, are made at once: each suffix finds
    its place in the neighbouring sorted run by binary search. Equal windows keep their input order.
    """

    def __init__(self, data: np.ndarray):
        self.data = np.r_[data, np.zeros(8, np.uint8)]
        self.hash = PrefixHash(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes on which the windows at a and b agree."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), WINDOW)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash.of(a, mid) == self.hash.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, head: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        """Whether window ia (at a) stands before window ib (at b); ties by number."""
        out = head[ia] < head[ib]
        close = np.flatnonzero(head[ia] == head[ib])
        if len(close):
            x, y = a[close], b[close]
            n = self.extension(x, y)
            inner = np.minimum(n, WINDOW - 1)
            out[close] = np.where(n >= WINDOW, ia[close] < ib[close], self.data[x + inner] < self.data[y + inner])
        return out

    def order(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Numbers of the windows in sorted order; ``group`` is non-decreasing."""
        n = len(at)
        head = np.zeros(n, np.uint64)
        for k in range(8):
            head = (head << np.uint64(8)) | self.data[at + k].astype(np.uint64)
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[begin, n])
        o, s = np.repeat(begin, size), np.repeat(size, size)
        local = np.arange(n) - o
        order, width = np.arange(n), 1
        while width < size.max(initial=0):
            run = local // width
            lo = np.minimum((run ^ 1) * width, s) + o
            hi = np.minimum(lo + width, o + s)
            live = np.flatnonzero(lo < hi)
            l, h, mine = lo[live], hi[live], order[live]
            while True:
                open_ = np.flatnonzero(l < h)
                if not len(open_):
                    break
                mid = (l[open_] + h[open_]) // 2
                other = order[mid]
                below = self.less(at[other], at[mine[open_]], head, other, mine[open_])
                l[open_] = np.where(below, mid + 1, l[open_])
                h[open_] = np.where(below, h[open_], mid)
            to = np.arange(n)
            pair = np.minimum(run, run ^ 1)[live] * width + o[live]
            to[live] = pair + (local[live] - run[live] * width) + (l - lo[live])
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, 2 * width
        return order

    def repeated(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether an equal window of its group comes before each window. Windows found equal by hash are compared byte by byte."""
        order = self.order(at, group)
        a, b = at[order[:-1]], at[order[1:]]
        near = np.flatnonzero(group[order[:-1]] == group[order[1:]])
        same = near[self.hash.of(a[near], WINDOW) == self.hash.of(b[near], WINDOW)]
        for i in range(0, len(same), 1 << 16):
            part = same[i : i + (1 << 16)]
            step = np.arange(WINDOW)
            if (self.data[a[part][:, None] + step] != self.data[b[part][:, None] + step]).any():
                return self._exactly(at, group)
        out = np.zeros(len(at), bool)
        out[order[same + 1]] = True
        return out

    def _exactly(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The same without hashes, for the case of a collision."""
        seen: set[tuple[int, bytes]] = set()
        out = np.zeros(len(at), bool)
        for i, (g, x) in enumerate(zip(group.tolist(), at.tolist(), strict=True)):
            k = (g, self.data[x : x + WINDOW].tobytes())
            out[i] = k in seen
            seen.add(k)
        return out


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (node, doc_id, start, windows, bytes) in the order of node -> (doc_id, start, windows) of the windows that are removed."""
    kept: pa.Table | None = None

    def solve(t: pa.Table) -> pa.RecordBatch:
        node, doc, start, windows = (t.column(k).to_numpy().astype(np.int64) for k in ("node", "doc_id", "start", "windows"))
        raw = t.column("bytes").to_pylist()
        o = np.lexsort((start, doc, node))
        node, doc, start, windows, raw = node[o], doc[o], start[o], windows[o], [raw[i] for i in o]
        sizes = np.array([len(x) for x in raw], np.int64)
        run = np.repeat(np.arange(len(o)), windows)
        step = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = (np.cumsum(sizes) - sizes)[run] + step
        again = SuffixSort(np.frombuffer(b"".join(raw), np.uint8)).repeated(at, node[run])
        # removed windows as runs of consecutive ones
        edge = np.flatnonzero(np.r_[True, (again[1:] != again[:-1]) | (run[1:] != run[:-1])])
        length = np.diff(np.r_[edge, len(again)])
        e, n = edge[again[edge]], length[again[edge]]
        return pa.record_batch([pa.array(doc[run[e]]), pa.array((start[run[e]] + step[e]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "start", "windows"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([kept, t]) if kept is not None else t
        node = t.column("node").to_numpy()
        last = int(np.flatnonzero(np.r_[True, node[1:] != node[:-1]])[-1])
        kept = t.slice(last).combine_chunks()
        if last:
            yield solve(t.slice(0, last))
    if kept is not None:
        yield solve(kept)


def _firsts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts that are the first of their node and bytes, places of all other parts). A key's rows meet its first in SALTS tasks."""
    key, place = ["node", "a", "b"], F.struct("doc_id", "start")
    first = stored(parts.groupBy(*key).agg(F.min(F.struct("doc_id", "start", "windows", "bytes")).alias("x"), F.count("*").alias("n")))
    again = first.where("n > 1").select(*key, F.struct("x.doc_id", "x.start").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = parts.select(*key, "doc_id", "start", "windows", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int").alias("salt"))
    gone = rows.join(again, [*key, "salt"]).where(place > F.col("first"))
    return first.select("node", "x.*"), gone.select("doc_id", "start", "windows")


def _hot(runs_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of hot anchors (node, doc_id, start, windows, bytes), all different: (parts to be sorted, places of removed windows)."""
    parts = stored(runs_.repartition(F.xxhash64("doc_id", "start")).mapInArrow(_parts_of_runs(PART), _PART_ROW))
    first, gone = _firsts(parts)
    counts = cut(first.groupBy("node").agg(F.count("*").alias("k")).where(F.col("k") > 1))
    large = cut(counts.where(F.col("k") > NODE_MAX).select("node"))
    small = first.join(counts.where(F.col("k") <= NODE_MAX).select("node"), "node", "left_semi")
    # as many nodes at most as there are parts divided by NODE_MAX
    wide = first.join(sized(large, large.count()), "node", "left_semi")
    single = stored(wide.repartition(F.xxhash64("doc_id", "start")).mapInArrow(_parts_of_runs(1), _PART_ROW).drop("bytes").withColumn("bytes", F.lit(b"")))
    return small, gone.unionAll(_firsts(single)[1])


def removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, windows): runs of windows that also start earlier; doc_id NO_ID stands for null. Runs may overlap."""
    base = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    found = base.mapInArrow(_all_runs, _RUN)
    sample = base.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(_all_runs, _RUN)
    hot = cut(sample.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("anchor", F.lit(True).alias("hot")))
    n_hot = hot.count()
    place = F.struct("doc_id", "start")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(-1)
    found = found.join(sized(hot, n_hot), "anchor", "left").withColumn("salt", salt).drop("hot")
    mine = Window.partitionBy("anchor", "salt")
    one = Window.partitionBy("anchor", "salt", "digest", "second")
    edges = {f"{f}_{c}": getattr(F, f)(c).over(mine) for f in ("min", "max") for c in ("digest", "second")}
    several = (F.col("min_digest") < F.col("max_digest")) | (F.col("min_second") < F.col("max_second"))
    found = found.withColumn("first", F.min(place).over(one)).withColumns(edges)
    found = found.select("anchor", "digest", "second", "doc_id", "start", "windows", "salt", (place > F.col("first")).alias("again"), several.alias("several"))
    found = stored(found.where("again or several or salt >= 0").drop("several"))
    gone = found.where("again").select("doc_id", "start", "windows")
    ask = found.where("not again and salt < 0").select("anchor", F.lit(False).alias("hot"), "doc_id", "start", "windows")
    if n_hot:  # at most SALTS equal runs of a hot anchor are left
        many = found.where("not again and salt >= 0").withColumn("first", F.min(place).over(Window.partitionBy("anchor", "digest", "second")))
        many = stored(many.select("anchor", "doc_id", "start", "windows", (place > F.col("first")).alias("again")))
        gone = gone.unionAll(many.where("again").select("doc_id", "start", "windows"))
        ask = ask.unionAll(many.where("not again").select("anchor", F.lit(True).alias("hot"), "doc_id", "start", "windows"))
    ask = ask.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "hot", "start", "windows")).alias("asked"))
    raw = base.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    got = raw.join(ask, "doc_id").select("doc_id", F.explode(F.expr(f"transform(asked, x -> struct(x.anchor AS node, x.hot, x.start, x.windows, substring(raw, x.start + 1, x.windows + {WINDOW - 1}) AS bytes))")).alias("x"))
    got = got.select("x.node", "x.hot", "doc_id", "x.start", "x.windows", "x.bytes").where(F.length("bytes") == F.col("windows") + (WINDOW - 1))
    todo = got
    if n_hot:
        todo = stored(got)
        parts, more = _hot(todo.where("hot").drop("hot"))
        gone = gone.unionAll(more)
        todo = todo.where("not hot").drop("hot").unionByName(parts)
    return gone.unionAll(todo.select("node", "doc_id", "start", "windows", "bytes").repartition("node").sortWithinPartitions("node").mapInArrow(_sorted_groups, "doc_id long, start int, windows int"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            edges = np.zeros(len(raw) + 1, np.int32)
            if spans.is_valid and len(spans.values):
                x = spans.values
                a, n = x.field(0).to_numpy(zero_copy_only=False).astype(np.int64), x.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(edges, np.minimum(a, len(raw)), 1)
                np.add.at(edges, np.minimum(a + n + (WINDOW - 1), len(raw)), -1)
            gone = np.cumsum(edges)[:-1] > 0
            starts = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if starts else raw
            rows.append((doc, len(raw), len(raw) - len(kept), starts, hashlib.sha256(kept).hexdigest(), kept))
        c = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.record_batch([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.string()), pa.array(c[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedupe(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that are left.

    Null texts are empty; texts under WINDOW bytes stay whole; null ids count as one document before all others, and so do other rows that share an
    id: equal places don't repeat each other, and what repeats in one is taken out of each at that place. An empty table gives no rows. Texts of
    any length are cut into runs whole, one text at a time. Runs of one anchor are taken for equal by 95 bits of two hashes, parts of hot
    ones by 128; windows that the suffix sort takes for equal are compared byte by byte.
    """
    spans = removed(docs, id_col, text).groupBy(F.col("doc_id").alias("__key")).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("key"))
    d = d.join(spans, F.col("key") == F.col("__key"), "left").select("doc_id", "text", "spans")
    return d.mapInArrow(_without, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return dedupe(docs).drop("kept")
