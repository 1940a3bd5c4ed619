"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index for links, and components of linked texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.components import connected
from tidemark.llm.text import named
from tidemark.session import cut

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Most shingles whose bits are unpacked at once (64 bytes each).
_CHUNK = 1 << 15
#: The three blocks of bits; fingerprints within MAX_BITS agree in one of them at least. (first bit, width), from the top.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Nodes with more fingerprints than this are dealt on by three parts of their other bits, so no task gets a whole hot node.
NODE_MAX = 50_000
#: Widths of the levels under a block's node, in bits from the top of what is left.
_LEVELS = (6, 6, 8, 10, 13)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text; 0 without words. A-Z are lower-cased, words end at ASCII white space."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < SHINGLE:
        w = [b" ".join(w)]
    else:
        w = [b"%b %b %b" % x for x in zip(w, w[1:], w[2:], strict=False)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(w), _CHUNK):
        part = w[i : i + _CHUNK]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(w)).astype(np.uint8)
    return int(np.packbits(bits).view(">u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): one row for each row of ``docs``."""
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text)).alias("fp"))


def gray_rank(v: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in Gray order: codes with equal upper bits stay side by side."""
    v = v.copy()
    for k in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(k)
    return v


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


class GrayIndex:
    """Codes sorted by Gray rank under a tree of shared bit patterns.

    A root is a group of codes that agree in ``width`` upper bits. A node of the next levels is a run of codes that agree in
    some more bits; it keeps that pattern once for all of them. ``links`` walks pairs of nodes downwards from each
    root with itself, adds the differing bits of their patterns and drops a pair, with all below it, once they exceed the bound.
    """

    def __init__(self, group: np.ndarray, code: np.ndarray, width: int):
        order = np.lexsort((gray_rank(code), group))
        self.code, group = code[order], group[order]
        self.patterns, self.first = [], []
        bits, cut_at = width, [_starts(group)]
        for step in _LEVELS:
            step = min(step, 64 - bits)
            if step <= 0:
                break
            bits += step
            top = self.code >> np.uint64(64 - bits)
            s = np.flatnonzero(np.r_[True, (top[1:] != top[:-1]) | (group[1:] != group[:-1])])
            self.patterns.append((top[s] & np.uint64((1 << step) - 1)).astype(np.uint64))
            cut_at.append(s)
        # children of node i of level k: nodes first[k][i] .. first[k][i+1] of level k + 1
        for up, down in zip(cut_at, cut_at[1:], strict=False):
            self.first.append(np.r_[np.searchsorted(down, up), len(down)])
        self.roots = len(cut_at[0])
        self.leaf = cut_at[-1]

    def links(self, bound: int = MAX_BITS, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different codes (as positions in ``code``) with at most ``bound`` differing bits."""
        r = np.arange(self.roots)
        todo = [(0, r, r, np.zeros(len(r), np.int64))]
        while todo:
            level, a, b, acc = todo.pop()
            if level == len(self.first):
                yield self.leaf[a[a != b]], self.leaf[b[a != b]]
                continue
            f = self.first[level]
            na, nb = f[a + 1] - f[a], f[b + 1] - f[b]
            n = na * nb
            if n.sum() > most and len(a) > 1:  # bounded memory: deeper parts one after the other
                half = len(a) // 2
                todo += [(level, a[:half], b[:half], acc[:half]), (level, a[half:], b[half:], acc[half:])]
                continue
            at = np.repeat(np.arange(len(a)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            ca, cb = f[a][at] + k // nb[at], f[b][at] + k % nb[at]
            half = ca <= cb  # each pair once
            at, ca, cb = at[half], ca[half], cb[half]
            p = self.patterns[level]
            acc2 = acc[at] + np.bitwise_count(p[ca] ^ p[cb])
            ok = acc2 <= bound
            todo.append((level + 1, ca[ok], cb[ok], acc2[ok]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position linked to each, by min-label passes; links are kept as they come."""
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(z) for z in zip(*pairs, strict=False))) if n else ([], [])
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (node, block, code) in the order of node -> links (a, b) that connect each node's close codes."""
    kept: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for block in np.unique(rows[1]).tolist():
            group, _, code = rows[:, rows[1] == block]
            index = GrayIndex(group, code, BLOCKS[block][1])
            pairs = list(index.links())
            if not pairs:
                continue
            root = _roots(len(index.code), iter(pairs))
            linked = np.flatnonzero(root != np.arange(len(root)))
            if len(linked):
                yield block, index.code[linked], index.code[root[linked]]

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for block, a, b in solve(rows):
            yield pa.record_batch([pa.array(np.full(len(a), block)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["block", "a", "b"])

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(i)).astype(np.int64).view(np.uint64) for i in range(3)])
        if not rows.shape[1]:
            continue
        rows = np.concatenate([*kept, rows], axis=1) if kept else rows
        last = int(_starts(rows[0])[-1])
        kept = [rows[:, last:]]
        if last:
            yield from out(rows[:, :last])
    if kept:
        yield from out(kept[0])


def links(codes: DataFrame) -> DataFrame:
    """(a, b): links between the distinct 64-bit codes of column ``fp`` that connect all pairs within MAX_BITS.

    Two codes at most two bits apart agree in one of three blocks of bits, so each code goes to three nodes, keyed by block
    and pattern. A node is searched in one task; nodes beyond NODE_MAX are dealt on by three blocks of their other bits.
    The rotation of a code puts the shared bits first; it is undone in what is returned.
    """
    rotate = lambda c, k: F.shiftleft(c, k).bitwiseOR(F.shiftrightunsigned(c, 64 - k)) if k else c
    c = F.col("fp")
    nodes = codes.select(F.explode(F.array(*(F.struct(F.lit(i).alias("block"), rotate(c, at).alias("code")) for i, (at, _) in enumerate(BLOCKS)))).alias("x")).select("x.*")
    # right shift by a column: the unsigned shift takes literals only, so each block is a branch
    pattern = F.coalesce(*(F.when(F.col("block") == i, F.shiftrightunsigned("code", 64 - w)) for i, (_, w) in enumerate(BLOCKS)))
    nodes = nodes.select("block", pattern.alias("pattern"), "code")
    sizes = nodes.groupBy("block", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > NODE_MAX)
    nodes = nodes.join(sizes, ["block", "pattern"], "left")
    # a hot node's other bits: three parts of 14, each in turn moved up behind the block
    rest = F.coalesce(*(F.when(F.col("block") == i, F.shiftleft("code", w)) for i, (_, w) in enumerate(BLOCKS)))
    parts = F.array(*(F.struct(F.lit(j).alias("part"), F.shiftrightunsigned(rotate(rest, 14 * j), 50).alias("sub")) for j in range(3)))
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub")))
    nodes = nodes.withColumn("p", F.explode(F.when(F.col("n").isNull(), whole).otherwise(parts)))
    node = F.xxhash64("block", "pattern", "p.part", "p.sub").alias("node")
    dealt = nodes.select(node, F.col("block").cast("long").alias("block"), "code").repartition("node").sortWithinPartitions("node")
    found = dealt.mapInArrow(_link_groups, "block long, a long, b long")
    back = lambda x: F.coalesce(*(F.when(F.col("block") == i, rotate(F.col(x), (64 - at) % 64)) for i, (at, _) in enumerate(BLOCKS)))
    return found.select(back("a").alias("a"), back("b").alias("b"))


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest id reachable over links. Rows without words share fingerprint 0 and are linked like
    any others. Null ids count as no id: such a row takes part, and a component of nothing else has a null id. Repeated rows each
    get a row. Other columns are not read.
    """
    f = cut(fingerprints(docs, id_col, text))
    codes = f.groupBy("fp").agg(F.min("doc_id").alias("low"))
    label = connected(links(codes))
    named = codes.join(label, codes.fp == label.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.select("fp", "root").join(low, "root").select(F.col("fp").alias("code"), "component_id")
    return f.join(named, f.fp == named.code).select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def report(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", hexadecimal().alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of its component; rows that repeat such an id stay once. Null ids stay."""
    c = components(docs)
    ids = c.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = cut(ids)
    kept = docs.join(ids.select("doc_id"), "doc_id", "left_semi").select([named(c) for c in docs.columns])
    if ids.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
