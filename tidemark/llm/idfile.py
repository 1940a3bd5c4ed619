"""Token ids in binary files of patched frame-of-reference blocks.

A file: the magic; blocks; the starts of all blocks (u8 each); the documents' ids (i8) and numbers of ids (u8); a tail of counts. A block holds
BLOCK ids: their least (u4), a width (u1), the number of exceptions (u2), all differences to the least packed at that width (0 for an
exception), the places of exceptions (u1 each) and their differences (u4 each). The width is that of the PERCENTILE-th difference.
The last block is filled up with its least. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.tokenizer import encoder, public
from tidemark.session import checkpoint_dir, cut

MAGIC, BLOCK, PERCENTILE = b"TIDEIDS1", 256, 95
VOCABULARY = "byte_bpe_50k.json"
#: Blocks packed or unpacked at once, texts of a file on average, and the id that stands for null.
STEP, FILE_TEXTS, NO_ID = 2048, 8_000, -(2**63)
_HEAD = 7
_TAIL = struct.Struct("<QQQQ")


def _width(x: np.ndarray) -> np.ndarray:
    """Bits of each value; at least 1."""
    return np.maximum(np.frexp(x.astype(np.float64))[1], 1).astype(np.int64)


def _packed(low: np.ndarray, w: int) -> np.ndarray:
    """Rows of values packed at w bits each, the first in the lowest bits: eight values make w bytes."""
    v = low.astype(np.uint64).reshape(len(low), -1, 8)
    out = np.zeros((*v.shape[:2], 5), np.uint64)  # eight values of 32 bits at most, and one more to spill into
    for k in range(8):
        at, bit = divmod(k * w, 64)
        out[:, :, at] |= v[:, :, k] << np.uint64(bit)
        if bit + w > 64:
            out[:, :, at + 1] |= v[:, :, k] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.astype("<u8").view(np.uint8)[:, :, :w]).reshape(len(low), -1)


def _unpacked(rows: np.ndarray, w: int) -> np.ndarray:
    """The values of such rows."""
    raw = np.zeros((len(rows), rows.shape[1] // w, 40), np.uint8)
    raw[:, :, :w] = rows.reshape(len(rows), -1, w)
    v = raw.view("<u8")
    out = np.empty((*v.shape[:2], 8), np.uint32)
    mask = np.uint64((1 << w) - 1)
    for k in range(8):
        at, bit = divmod(k * w, 64)
        x = v[:, :, at] >> np.uint64(bit)
        if bit + w > 64:
            x = x | (v[:, :, at + 1] << np.uint64(64 - bit))
        out[:, :, k] = x & mask
    return out.reshape(len(rows), -1)


def pack(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``ids``, whose number is a multiple of BLOCK."""
    x = ids.astype(np.int64).reshape(-1, BLOCK)
    least = x.min(axis=1)
    d = (x - least[:, None]).astype(np.uint32)
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = _width(np.partition(d, at, axis=1)[:, at])
    odd = (d >> (width - 1).astype(np.uint32)[:, None]) > 1
    body: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        rows = _packed(np.where(odd[own], 0, d[own]), w)
        raw, size = rows.tobytes(), rows.shape[1]
        for k, i in enumerate(own.tolist()):
            body[i] = raw[k * size : (k + 1) * size]
    block, place = np.nonzero(odd)
    n = odd.sum(axis=1)
    end = np.cumsum(n)
    values = d[block, place].astype("<u4")
    place = place.astype(np.uint8)
    return [struct.pack("<IBH", m, w, k) + b + place[e - k : e].tobytes() + values[e - k : e].tobytes() for m, w, k, e, b in zip(least.tolist(), width.tolist(), n.tolist(), end.tolist(), body, strict=True)]


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts`` of a byte array."""
    take = lambda at, n: np.lib.stride_tricks.sliding_window_view(data, n)[at]
    head = take(starts, _HEAD)
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, n = head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 5:7]).view("<u2").ravel().astype(np.int64)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        out[own] = _unpacked(take(starts[own] + _HEAD, BLOCK * w // 8), w)
    if n.sum():
        block = np.repeat(np.arange(len(starts)), n)
        k = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
        base = (starts + _HEAD + BLOCK * width // 8)[block]
        values = np.ascontiguousarray(take(base + n[block] + 4 * k, 4)).view("<u4").ravel()
        out[block, data[base + k]] = values
    return (out + least[:, None]).ravel()


def _open(uri: str):
    """(file system, path): local paths and file: by the local one, others by their scheme."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, documents: Iterator[tuple[int, np.ndarray]]) -> tuple[int, int, int]:
    """Documents' ids to one file, in their order: (documents, ids, bytes). The file gets its name only when it is whole."""
    store, path = _open(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    starts, names, counts, wait, n_wait, at = [], [], [], [], 0, len(MAGIC)
    total = 0
    with store.open_output_stream(part) as out:
        out.write(MAGIC)

        def flush(last: bool) -> None:
            nonlocal wait, n_wait, at
            ids = np.concatenate(wait) if wait else np.zeros(0, np.uint32)
            if last and len(ids) % BLOCK:
                ids = np.r_[ids, np.full(-len(ids) % BLOCK, ids[len(ids) // BLOCK * BLOCK :].min(), ids.dtype)]
            whole = len(ids) // BLOCK * BLOCK
            for i in range(0, whole, STEP * BLOCK):
                blocks = pack(ids[i : min(whole, i + STEP * BLOCK)])
                sizes = np.array([len(b) for b in blocks])
                starts.append(at + np.cumsum(sizes) - sizes)
                at += int(sizes.sum())
                out.write(b"".join(blocks))
            wait, n_wait = [ids[whole:]], len(ids) - whole

        for name, ids in documents:
            names.append(name)
            counts.append(len(ids))
            wait.append(ids)
            n_wait += len(ids)
            total += len(ids)
            if n_wait >= STEP * BLOCK:
                flush(False)
        flush(True)
        index = np.concatenate(starts).astype("<u8") if starts else np.zeros(0, "<u8")
        out.write(index.tobytes() + np.array(names, "<i8").tobytes() + np.array(counts, "<u8").tobytes())
        out.write(_TAIL.pack(len(index), len(names), total, at) + MAGIC)
        size = at + 8 * len(index) + 16 * len(names) + _TAIL.size + len(MAGIC)
    store.move(part, path)
    return len(names), total, size


def read_file(uri: str) -> Iterator[tuple[int, np.ndarray]]:
    """The documents of a file in order; STEP blocks are in memory at once, and the longest document."""
    store, path = _open(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        f.seek(size - _TAIL.size - len(MAGIC))
        tail = f.read()
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{uri} is not a whole id file")
        n_blocks, n_docs, _, end = _TAIL.unpack(tail[: _TAIL.size])
        f.seek(end)
        starts = np.frombuffer(f.read(8 * n_blocks), "<u8").astype(np.int64)
        names = np.frombuffer(f.read(8 * n_docs), "<i8")
        counts = np.frombuffer(f.read(8 * n_docs), "<u8").astype(np.int64)
        bounds = np.r_[starts, end]
        have, block = np.zeros(0, np.uint32), 0
        for name, n in zip(names.tolist(), counts.tolist(), strict=True):
            parts, got = [have], len(have)
            while got < n:
                stop = min(block + STEP, n_blocks)
                f.seek(int(bounds[block]))
                data = np.frombuffer(f.read(int(bounds[stop] - bounds[block])), np.uint8)
                parts.append(unpack(data, starts[block:stop] - bounds[block]))
                got += len(parts[-1])
                block = stop
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield name, have[:n]
            have = have[n:]


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode all texts into files below ``folder``, ascending by id over all files: a row for each file (file, path, docs, ids, bytes).

    The files are written when this is called, each by one task, under a passing name until it is whole, so lost or repeated tasks leave no
    half file. ``folder`` must be one that all executors share. Nulls come first; equal ids are ordered by a hash of their text. A text of any
    length is encoded whole, and its blocks are written as they fill; a task holds some millions of characters at once, and its longest text.
    """
    path = vocabulary or public(VOCABULARY)
    folder = folder.rstrip("/")
    store, local = _open(folder)
    store.create_dir(local, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoder(path), TaskContext.get().partitionId()

        def documents() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True)

        name = f"{folder}/part-{number:06d}.ids"
        n, ids, size = write_file(name, documents())
        yield pa.record_batch([pa.array([number]), pa.array([name]), pa.array([n]), pa.array([ids]), pa.array([size])], names=["file", "path", "docs", "ids", "bytes"])

    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    files = max(1, -(-docs.count() // FILE_TEXTS))
    return cut(d.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(put, "file long, path string, docs long, ids long, bytes long"))


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that ``write`` returned."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for name, ids in read_file(path):
                    rows.append((None if name == NO_ID else name, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    d = files.select("path", F.coalesce(before, F.lit(0)).alias("start"), "docs").where("docs > 0")
    # a number of partitions of its own: adaptive execution would put all these small rows into one task
    return d.select("path", "start").repartition(max(1, files.count())).mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write to the shared checkpoint folder, and what reading the files gives. Null texts are empty: one id. An empty table gives no rows."""
    folder = f"{checkpoint_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return read(write(docs, folder, id_col, text, vocabulary))
