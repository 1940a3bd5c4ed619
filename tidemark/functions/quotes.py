"""Quotes found in a text modulo case, marks and white space, with places in the text as it is."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from tidemark.functions.text import fold

SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("whole", BooleanType())]))


def mapped(text: str) -> tuple[str, list[int]]:
    """The normal form of a text, and for each of its characters the place in the text that it comes from.

    Each character is folded by itself: one may become none (a mark) or several. A run of white space is one blank, from its first character.
    """
    out: list[str] = []
    source: list[int] = []
    for i, c in enumerate(text):
        if c.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                source.append(i)
            continue
        for x in c.lower() if c.isascii() else fold(c) or "":
            out.append(x)
            source.append(i)
    return "".join(out), source


def _in_word(text: str, at: int) -> bool:
    """Whether a place lies between two characters of one word; marks belong to the letter before them."""
    word = lambda c: c.isalnum() or c == "_" or unicodedata.category(c).startswith("M")
    return 0 < at < len(text) and word(text[at - 1]) and word(text[at])


def find_verbatim(quote: str, text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of each place of ``text`` that reads as ``quote``, overlapping ones too; whole: it cuts no word. A quote without characters has none."""
    needle, (hay, source) = mapped(quote)[0].strip(), mapped(text)
    out = []
    at = hay.find(needle) if needle else -1
    while at >= 0:
        start, end = source[at], source[at + len(needle) - 1] + 1
        inside = (at > 0 and source[at - 1] == start) or (at + len(needle) < len(hay) and source[at + len(needle)] == end - 1)  # a part of what one character became
        while end < len(text) and unicodedata.category(text[end]).startswith("M"):
            end += 1
        if not inside:
            out.append((start, end, not _in_word(text, start) and not _in_word(text, end)))
        at = hay.find(needle, at + 1)
    return out


@F.pandas_udf(SPANS)
def spans(quotes: pd.Series, texts: pd.Series) -> pd.Series:
    """``find_verbatim`` row by row; null where either is null."""
    one = lambda q, t: None if q is None or t is None else [{"start": a, "end": b, "whole": w} for a, b, w in find_verbatim(q, t)]
    return pd.Series([one(q, t) for q, t in zip(quotes, texts, strict=True)], dtype=object)


def splice(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    """``text`` with the characters from ``start`` (0 first) to before ``end`` replaced; all others stay as they are."""
    return F.concat(F.substring(text, F.lit(1), start), replacement, F.substring(text, end + 1, F.length(text)))


def why_not(text: Column, found: Column, replacement: Column, least_words: int = 3, ratio: int = 3) -> Column:
    """Why a found quote may not be replaced, or null: not there, there twice, cuts a word, is nearly all of the text, the same, or much longer."""
    one = F.get(found, 0)
    was = F.substring(text, one.start + 1, one.end - one.start)
    outside = F.size(F.regexp_extract_all(splice(text, one.start, one.end, F.lit(" ")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return (
        F.when(F.coalesce(F.size(found), F.lit(0)) < 1, "absent").when(F.size(found) > 1, "repeated").when(~one.whole, "cuts-word").when(outside < least_words, "whole")
        .when(replacement == was, "same").when(F.length(replacement) > ratio * F.length(was), "too-long")
    )
