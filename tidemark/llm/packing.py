"""Packing by vector bin packing: pieces of texts share a sequence under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokenizer import encoder, public

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 128, 4096
VOCABULARY = "word_bpe_49k.json"
#: Texts for a group on average; a group is packed in one task.
GROUP_TEXTS = 16_000


def dot_product_bins(demand: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in bin) of each item (a row of demands, each within ``limit``).

    A bin takes, again and again, the item that fits and has the largest dot product of its demands with the room left (both as shares
    of the limits); when none fits the next bin opens. Equal items are one class with a count, so a step costs the number of classes.
    """
    n = len(demand)
    where, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return where, place
    kind, inverse, count = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    members = np.argsort(inverse, kind="stable")  # items by class, in input order
    at = np.r_[0, np.cumsum(count)][:-1]
    live = np.arange(len(kind))
    columns = list(np.ascontiguousarray(kind.T, np.float64))  # of the classes that are left
    room, b, k = limit.astype(np.float64), 0, 0
    left = n
    while left:
        # room / limit * demand / limit, summed over the demands
        score = sum(c * w for c, w in zip(columns, (room / limit / limit).tolist(), strict=True))
        for c, r in zip(columns, room.tolist(), strict=True):
            score[c > r] = -1.0
        x = int(score.argmax())
        if score[x] < 0:
            room, b, k = limit.astype(np.float64), b + 1, 0
            continue
        best = live[x]
        item = members[at[best]]
        at[best] += 1
        count[best] -= 1
        where[item], place[item] = b, k
        room, k, left = room - kind[best], k + 1, left - 1
        if not count[best]:
            live = np.delete(live, x)
            columns = [np.delete(c, x) for c in columns]
    return where, place


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, size: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each text's ids with the end id, cut every ``size`` ids. Null texts are empty: one id.

    The id column keeps its type. A text of any length is encoded whole, in the task that reads it.
    """
    path = vocabulary or public(VOCABULARY)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for row, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                wide = ids.astype("<u4")
                for start in range(0, len(wide), size):
                    part = wide[start : start + size]
                    rows.append((row, start, len(part), zlib.crc32(part), len(wide)))
            c = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.record_batch([batch.column(0).take(c[0]), *c[1:]], names=names)

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(cut, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:]))


def pack(items: DataFrame, groups: int, loss: str = "length", limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)) -> DataFrame:
    """``items`` (doc_id, start, length and more) with sequence_id and offset.

    Items are dealt into ``groups`` by a hash of id and size, each packed in one task; only these small rows are shuffled. ``loss`` names the
    loss-bearing tokens of an item. Items must lie within the limits. sequence_id is the group in the upper bits and a count below.
    """
    columns = items.columns

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        demand = np.stack([frame["length"], np.ones(len(frame), np.int64), frame[loss]], axis=1).astype(np.int64)
        where, place = dot_product_bins(demand, np.array(limits))
        frame["sequence_id"] = (frame["__group"].to_numpy(np.int64) << 32) + where
        order = np.lexsort((place, where))
        sizes = frame["length"].to_numpy(np.int64)[order]
        before = np.cumsum(sizes) - sizes
        first = np.r_[True, where[order][1:] != where[order][:-1]]
        offset = np.empty(len(frame), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        frame["offset"] = offset
        return frame[[*columns, "sequence_id", "offset"]]

    # by all of a piece's place and content: the pieces of one huge text, or of many rows without an id, are dealt over all groups
    group = F.pmod(F.xxhash64("doc_id", "doc_tokens", "start", "ids_crc32"), F.lit(groups)).alias("__group")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return items.select("*", group).groupBy("__group").applyInPandas(one, schema)


def instruction_sequences(turns: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", vocabulary: str | None = None, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS // 2)) -> DataFrame:
    """All turns of conversations packed under all three limits; ``loss`` (long) of a piece is its length if the assistant speaks, else 0.

    A row for each piece: doc_id (the conversation), turn, role, start, length, ids_crc32, doc_tokens (of the turn), loss, sequence_id, offset. Pieces
    are cut so that each is within the limits. Turns are packed one by one, so one huge conversation is dealt like any others.
    """
    size = min(limits[0], limits[2])
    key = turns.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(turn).alias("turn"), F.col(role).alias("role")).alias("key"), F.col(text).alias("text"))
    p = pieces(key, "key", "text", vocabulary, size)
    items = p.select("doc_id.*", *p.columns[1:]).withColumn("loss", F.when(F.col("role") == "assistant", F.col("length")).otherwise(F.lit(0)).cast("long"))
    return pack(items, max(1, -(-turns.count() // GROUP_TEXTS)), "loss", limits)


def sequences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """All texts of ``docs`` packed into sequences of at most MAX_TOKENS ids: a row for each piece.

    Empty and null texts are their end id. Repeated rows and null ids are packed like others. An empty table gives no rows. Other columns are not read.
    """
    groups = max(1, -(-docs.count() // GROUP_TEXTS))
    return pack(pieces(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), vocabulary=vocabulary), groups)
