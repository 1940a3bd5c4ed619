"""Tokens of texts by a published vocabulary: counts, offsets, and cuts at a number of tokens."""

from __future__ import annotations

import os
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

HEAD = StructType([StructField("tokens", IntegerType()), StructField("text", StringType()), StructField("cut", BooleanType())])


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def offsets(text: str, path: str) -> list[int]:
    """The place of the first character of each token."""
    return [a for a, _ in _tokenizer(path).encode(text, add_special_tokens=False).offsets]


def head(text: str, most: int, path: str) -> tuple[int, str, bool]:
    """(tokens of the text, its longest beginning that ends with a token and has at most so many, whether that is less than the text)."""
    starts = offsets(text, path)
    if len(starts) <= most:
        return len(starts), text, False
    at = most
    while at > 0 and len(offsets(text[: starts[at]], path)) > most:  # a cut may change how the end is read
        at -= 1
    return len(starts), text[: starts[at]] if at > 0 else "", True


def counted(text: Column, path: str | None = None) -> Column:
    """Tokens of each text; null for null."""
    path = path or vocabulary()

    @F.pandas_udf(IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        n = [len(e.ids) for e in _tokenizer(path).encode_batch(known.tolist(), add_special_tokens=False)]
        return pd.Series(n, index=known.index, dtype="Int32").reindex(texts.index)

    return run(text)


def headed(text: Column, most: int, path: str | None = None) -> Column:
    """``head`` of each text as (tokens, text, cut); null for null."""
    path = path or vocabulary()

    @F.pandas_udf(HEAD)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if t is None else head(t, most, path) for t in texts], columns=["tokens", "text", "cut"]).astype({"tokens": "Int32"})

    return run(text)


def token_offsets(text: Column, path: str | None = None) -> Column:
    path = path or vocabulary()

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else offsets(t, path) for t in texts], dtype=object)

    return run(text)
