"""Fill-in-middle: texts are cut at two drawn unit counts and their parts put in another order behind sentinels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before the prefix, the suffix and the middle. A text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Draws are by this seed; of 100 texts so many are cut, and of 100 cut ones so many have the suffix first.
SEED, CUT, SUFFIX_FIRST = 42, 50, 80
#: Bytes of a block of the tree, and of what is looked at in one go while blocks are counted.
BLOCK, STEP = 1024, 1 << 20
#: Bytes of output handed on at once.
BATCH_BYTES = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class BlockTree:
    """Fenwick tree over blocks of BLOCK bytes of a UTF-8 text: unit ends and code points of any number of first blocks in logarithmic steps.

    A unit is white space (space, tab to carriage return) and the run of other characters behind it; white space at the end is a unit of its own.
    The white space is ASCII, so a unit ends where a byte that is none stands before one that is, and at the end of the text.
    """

    def __init__(self, text: bytes) -> None:
        self.text = text
        units, chars = [], []
        for a in range(0, len(text), STEP):
            ends, first = self._marks(a, min(len(text), a + STEP))
            at = np.arange(0, len(ends), BLOCK)
            units.append(np.add.reduceat(ends, at, dtype=np.int64))
            chars.append(np.add.reduceat(first, at, dtype=np.int64))
        self.units = self._tree(units)
        self.chars = self._tree(chars)
        self.n_units, self.n_chars = sum(int(u.sum()) for u in units), sum(int(c.sum()) for c in chars)
        self.top = 1 << (len(self.units) - 1).bit_length() >> 1 if len(self.units) > 1 else 0

    def _marks(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each byte of text[a:b] ends a unit, and whether it begins a code point."""
        raw = np.frombuffer(self.text, np.uint8, min(b + 1, len(self.text)) - a, a)
        space = _SPACE[raw]
        if b == len(self.text):
            ends = np.empty(b - a, bool)
            ends[:-1] = ~space[:-1] & space[1:]
            ends[-1] = True
        else:
            ends = ~space[:-1] & space[1:]
        return ends, (raw[: b - a] & 0xC0) != 0x80

    @staticmethod
    def _tree(counts: list[np.ndarray]) -> list[int]:
        """Node i holds the sum of the last i & -i of the first i blocks."""
        t = [0, *np.concatenate(counts).tolist()] if counts else [0]
        for i in range(1, len(t)):
            up = i + (i & -i)
            if up < len(t):
                t[up] += t[i]
        return t

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``k`` units: descend to the block that holds the k-th end, then look for it there."""
        if k <= 0:
            return 0, 0
        block, chars, step = 0, 0, self.top
        while step:
            nxt = block + step
            if nxt < len(self.units) and self.units[nxt] < k:
                block, k, chars = nxt, k - self.units[nxt], chars + self.chars[nxt]
            step >>= 1
        a = block * BLOCK
        ends, first = self._marks(a, min(len(self.text), a + BLOCK))
        end = int(np.flatnonzero(ends)[k - 1]) + 1
        return a + end, chars + int(first[:end].sum())


def draws(name: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the SHA-256 of ``seed:name``."""
    h = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4]) for i in (0, 4, 8, 12))


def arrange(text: bytes, name: str, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text; form is plain, psm or spm."""
    tree = BlockTree(text)
    h1, h2, h3, h4 = draws(name, seed)
    n = tree.n_units
    if not text or h3 % 100 >= cut or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_chars), (b, b_chars) = tree.cut(i), tree.cut(j)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    spm = h4 % 100 < suffix_first
    out = s + text[b:] + p + text[:a] + m + text[a:b] if spm else p + text[:a] + s + text[b:] + m + text[a:b]
    return n, "spm" if spm else "psm", a_chars, b_chars - a_chars, out


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    The id and the seed draw the cuts, so equal rows get equal results and a row's doesn't hang on others; a null id draws as ``null``. A null text is
    empty and, as every empty one, plain with no units; an empty table gives no rows. Texts of any length are cut whole: beside a text and its output
    two numbers for each block of it are in memory. Other columns of ``docs`` are not read, whatever they are called.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                x = arrange(t.as_py(), "null" if i is None else i, seed, cut, suffix_first)
                rows.append((i, *x))
                size += len(x[-1])
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        name, n, form, p, m, out = zip(*rows, strict=True)
        raw = pa.array(out, pa.binary())
        as_text = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())  # the bytes as they are, also where they are no UTF-8
        return pa.record_batch([pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(form), pa.array(p, pa.int64()), pa.array(m, pa.int64()), as_text], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType
    d = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    out = d.mapInArrow(run, "id string, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(F.col("id").cast(kind).alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No sentinel can stand in a cut text, nor arise where a part meets one, so the first of each is the one put there."""
    first, last = (lambda c, m: F.substring_index(c, m, 1)), (lambda c, m: F.substring_index(c, m, -1))
    middle = last(output, MIDDLE)
    psm = F.concat(first(last(output, PREFIX), SUFFIX), middle, first(last(output, SUFFIX), MIDDLE))
    spm = F.concat(first(last(output, PREFIX), MIDDLE), middle, first(last(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``transform`` with digests of the output and of the text restored from it in place of the output."""
    d = transform(docs, id_col, text)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select(id_col, "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same by regular expressions and list slices.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS o FROM d),
p AS (SELECT doc_id, n, t, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN o < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(a, b)], '') AS x, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS y, array_to_string(u[greatest(a, b) + 1:], '') AS z FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(x || y || z) AS restored_sha256 FROM p
"""
