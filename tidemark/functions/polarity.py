"""Whether a claim keeps what its quotes deny or hedge, and whether the quotes name the claim's subjects; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that deny and words that hedge (fixed values).
NEGATIONS = ("not", "no", "never", "none", "neither", "nor", "without", "cannot", "nicht", "kein", "keine", "nie", "ohne", "değil", "yok", "hiç")
HEDGES = ("may", "might", "could", "should", "would", "possibly", "probably", "planned", "kann", "könnte", "belki", "olabilir")
#: Words that say nothing by themselves.
PLAIN = ("the", "and", "for", "are", "was", "were", "been", "has", "have", "had", "does", "did", "with", "that", "this", "from", "into", "its", "any", "all")
#: Words on one side that a denial or hedge is about, at most.
REACH = 6
#: Ends of clauses.
CLAUSE = r"[.,;:!?\n]+|\s(?:but|while|whereas|aber|ama)\s"
NAMED = r"^(?:\p{Lu}[\p{L}]*-?[0-9][\p{L}0-9-]*|\p{Lu}{2,}|.*\.(?:md|py|toml|json|yaml|sql|txt|sh))$"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def clauses(text: Column) -> Column:
    """The lower-cased words of each clause; ``n't`` is read as ``not`` and ``x-free`` as ``no x``."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"n['’]t\b", " not"), r"([\p{L}\p{N}]+)-free\b", "no $1")
    return F.transform(F.split(t, CLAUSE), lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _content(words: Column) -> Column:
    return F.filter(words, lambda x: (F.length(x) >= 3) & ~x.isin(*NEGATIONS, *HEDGES, *PLAIN))


def scopes(text: Column, kind: tuple[str, ...]) -> Column:
    """What each word of ``kind`` is about: the content words among the REACH words after it in its clause or, if there are none, before it."""

    def of(c: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = _content(F.slice(c, i + 2, F.lit(REACH)))
            before = _content(F.slice(c, F.greatest(i - (REACH - 1), F.lit(1)), F.least(i, F.lit(REACH))))
            return F.when(x.isin(*kind), F.when(F.size(after) > 0, after).otherwise(before))

        return F.filter(F.transform(c, one), lambda s: F.size(s) > 0)

    return F.flatten(F.transform(clauses(text), of))


def _same(a: Column, b: Column) -> Column:
    """One word is the other, or begins with it if that has four letters or more."""
    long = lambda x, y: (F.length(y) >= 4) & F.startswith(x, y)
    return (a == b) | long(a, b) | long(b, a)


def lost(denied: Column, stated: Column, kept: Column) -> Column:
    """A scope of ``denied`` two of whose words (all, if fewer) are among ``stated`` words, and that shares no word with a scope of ``kept``."""
    hits = lambda s: F.size(F.filter(s, lambda x: F.exists(stated, lambda y: _same(x, y))))
    meets = lambda s: F.exists(kept, lambda k: F.exists(k, lambda y: F.exists(s, lambda x: _same(x, y))))
    return F.exists(denied, lambda s: (hits(s) >= F.least(F.lit(2), F.size(s))) & ~meets(s))


def judged(rows: DataFrame, claim: str, quote: str) -> DataFrame:
    """``rows`` with ``polarity``: ``dropped`` (the quote denies what the claim states), ``inserted`` (the claim denies what the quote states), ``hardened`` (the quote hedges what the
    claim states), else ``kept``. A hedge that the claim adds is no fault. Null texts are empty.
    """
    col, sides = F.col, {"c": claim, "q": quote}
    parts = {f"__{k}_{name}": scopes(col(text), kind) for k, text in sides.items() for name, kind in (("no", NEGATIONS), ("may", HEDGES))}
    parts |= {f"__{k}_words": _content(F.flatten(clauses(col(text)))) for k, text in sides.items()}
    verdict = F.when(lost(col("__q_no"), col("__c_words"), col("__c_no")), "dropped").when(lost(col("__c_no"), col("__q_words"), col("__q_no")), "inserted")
    verdict = verdict.when(lost(col("__q_may"), col("__c_words"), col("__c_may")), "hardened").otherwise("kept")
    return rows.withColumns(parts).withColumn("polarity", verdict).drop(*parts)


def _stripped(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: F.regexp_replace(x, EDGES, ""))


def subjects(text: Column) -> Column:
    """Named subjects in order, each once: identifiers, acronyms, file names, and words with a capital that open no sentence."""
    raw, bare = F.split(F.coalesce(text, F.lit("")), r"\s+"), _stripped(text)

    def named(x: Column, i: Column) -> Column:
        inside = (i > 0) & ~F.rlike(F.coalesce(F.get(raw, i - 1), F.lit(".")), F.lit(r"[.!?:;]$"))
        return F.rlike(x, F.lit(NAMED)) | (inside & F.rlike(x, F.lit(r"^\p{Lu}\p{Ll}+$")))

    return F.array_distinct(F.filter(bare, named))


def unattributed(claim: Column, quote: Column) -> Column:
    """The claim's named subjects that aren't words of the quote, letter case aside."""
    held = F.transform(_stripped(quote), lambda x: F.lower(x))
    return F.filter(subjects(claim), lambda x: ~F.array_contains(held, F.lower(x)))
