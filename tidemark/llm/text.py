"""Column expressions on words and lines, shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, for matches that punctuation and case shall not break."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` uses it, also inside lambdas and where filters are pushed down."""
    return F.get(F.transform(F.array(value), body), 0)


def windows(hashes: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` items of ``hashes`` (an array of long), in order; none if it is shorter."""

    def runs(e: Column) -> Column:
        one = lambda x, i: F.xxhash64(x, *(F.get(e, i + k) for k in range(1, size)))
        return F.when(F.size(e) >= size, F.slice(F.transform(e, one), F.lit(1), F.size(e) - (size - 1))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, runs)


def named(column: str) -> Column:
    """The column of that very name, which may hold dots and backquotes."""
    return F.col("`" + column.replace("`", "``") + "`")
