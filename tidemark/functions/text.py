"""Text functions: normal forms, terms, slugs, statements, and rules for personal data and secrets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold(text: str | None) -> str | None:
    """NFKC, casefolded, decomposed, marks dropped, dotless i as i; applying it twice changes nothing more."""
    if text is None:
        return None
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in t if not unicodedata.category(c).startswith("M")).replace("ı", "i")


#: Texts of an Arrow batch that are Python strings at one time.
AT_ONCE = 64


def over(f: Callable[[str], str | None]):
    """A function of Arrow batches that makes ``f`` of each text (null: null), few at a time, so that a task holds a batch as Arrow has it and never as strings."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.string())
        parts = ([None if t is None else f(t) for t in texts[i : i + AT_ONCE].to_pylist()] for i in range(0, len(texts), AT_ONCE))
        return pa.concat_arrays([pa.array(x, pa.string()) for x in parts])

    return run


#: ``fold`` in Arrow batches; Spark has no function for normal forms.
normalise = over(fold)


def terms(text: Column, most: int = 24) -> Column:
    """Words that may hold dots, slashes and hyphens inside, of two characters or more, each once, at most ``most``."""
    w = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_./-]*"), F.lit(0))
    w = F.filter(F.transform(w, lambda x: F.regexp_replace(x, r"[./-]+$", "")), lambda x: F.length(x) >= 2)
    return F.slice(F.array_distinct(w), 1, most)


def is_identifier(term: Column) -> Column:
    return term.rlike("[_/.0-9]")


def slug(text: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def statements(text: Column) -> Column:
    """Lines and sentences without list marks; blank ones are dropped."""
    parts = F.split(text, r"\n|[.!?] ")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+", ""))), lambda s: s != "")


def shingles(words: Column, n: int) -> Column:
    """Different runs of n words."""
    k = F.size(words) - (n - 1)
    return F.when(k > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))


#: Kinds of personal data and secrets, in the order in which they are masked. Patterns use what Java's and RE2's dialects share.
RULES = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,-]*-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\s]*)"),
    ("aws-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("bearer", r"\b[Bb]earer [A-Za-z0-9._~+/-]{16,}"),
    ("assignment", r"(?i)\b(?:password|passwd|secret|token|api_?key)\b\s*[:=]\s*\S+"),
    ("dsn", r"\b[a-z]+://[^\s:/@]+:[^\s:/@]+@[^\s/]+"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"),
    ("phone", r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?(?:[ -]?[0-9]{2,4}){2,3}"),
    ("card", r"\b[0-9]{13,16}\b"),
    ("hex40", r"\b[0-9a-f]{40}\b"),
)


#: What a text must hold for any rule to match: one of these strings, a digit, or 40 digits and letters of hex.
NEEDS = ("-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "earer ", ":", "=", "@", "+")


def suspect(text: Column) -> Column:
    """A cheap test that all texts pass which break a rule; most texts don't, and are spared the rules."""
    out = text.rlike("[0-9]|[a-f]{40}")
    for s in NEEDS:
        out = F.contains(text, F.lit(s)) | out
    return out


def findings(text: Column) -> Column:
    """Names of the rules that a text breaks, in rule order."""
    all_ = F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in RULES)), lambda x: x.isNotNull())
    return F.when(suspect(text), all_).otherwise(F.array().cast("array<string>"))


def mask(text: Column) -> Column:
    """Every finding replaced by its rule's name in brackets; earlier rules go first."""
    out = text
    for name, pattern in RULES:
        out = F.regexp_replace(out, pattern, f"[{name}]")
    return F.when(suspect(text), out).otherwise(text)
