"""JSON values as text: canonical form, merge patches, and keys taken out at any depth."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Number(float):
    """A number that is written as it was read."""

    def __new__(cls, text: str) -> _Number:
        x = super().__new__(cls, text)
        x.text = text
        return x

    def __repr__(self) -> str:
        return self.text


def parse(text: str) -> Any:
    return json.loads(text, parse_float=_Number)


def canonical(value: Any) -> str:
    """Keys sorted at every depth, no blanks, letters as they are; decimal numbers are written as they were read."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return repr(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def merge(target: Any, patch: Any) -> Any:
    """A merge patch (RFC 7396): objects are merged key by key, null takes a key away, all else takes the place of what was there."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge(out.get(k), v)
    return out


def without(value: Any, keys: frozenset[str]) -> Any:
    """``value`` without the keys, at any depth."""
    if isinstance(value, dict):
        return {k: without(v, keys) for k, v in value.items() if k not in keys}
    return [without(v, keys) for v in value] if isinstance(value, list) else value


def _try(f: Callable[..., str], *texts: str | None) -> str | None:
    """Null where a text is null or no JSON."""
    try:
        return None if any(t is None for t in texts) else f(*map(parse, texts))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    return pd.Series([_try(canonical, t) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def merged_text(targets: pd.Series, patches: pd.Series) -> pd.Series:
    """The canonical text of the first value with the second as a merge patch."""
    return pd.Series([_try(lambda a, b: canonical(merge(a, b)), t, p) for t, p in zip(targets, patches, strict=True)], dtype=object)


def without_keys(*keys: str):
    """An Arrow function: the canonical text of a value without the keys."""
    gone = frozenset(keys)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_try(lambda v: canonical(without(v, gone)), t) for t in texts], dtype=object)

    return run
