"""Claims held against the quotes they rest on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import polarity as L
from tidemark.plans.registry import operator
from tidemark.sources.tables import table

# the words of a text as claim and quote: as they are, denied or hedged on one side or both, in their clause or in another one
_CLAIM = """concat(CASE doc_id % 8 WHEN 1 THEN concat(a, ' not ', b) WHEN 2 THEN concat(a, ' never ', b) WHEN 4 THEN concat(a, ' may ', b) WHEN 6 THEN concat(a, ' ', b, '. Not elsewhere') ELSE concat(a, ' ', b) END,
  CASE doc_id % 5 WHEN 0 THEN ' by D-12' WHEN 1 THEN ' in NATO' WHEN 2 THEN ' with Alice, see notes.md' ELSE '' END)"""
_QUOTE = """concat(CASE doc_id % 8 WHEN 0 THEN concat(a, ' not ', b) WHEN 1 THEN concat(a, ' doesn’t ', b) WHEN 3 THEN concat(a, ' might ', b) WHEN 5 THEN concat(a, ' ', b, ', not elsewhere') WHEN 6 THEN concat(a, ' without ', b) WHEN 7 THEN concat(a, ' is ', b, '-free') ELSE concat(a, ' ', b) END,
  CASE doc_id % 3 WHEN 0 THEN ' (d-12; nato: alice)' ELSE '' END)"""


def _in(words):
    return ", ".join(f"'{x}'" for x in words)


_KEEP = f"lambda v: length(v) >= 3 AND v NOT IN ({_in((*L.NEGATIONS, *L.HEDGES, *L.PLAIN))})"
_CLAUSES = r"list_transform(regexp_split_to_array(regexp_replace(regexp_replace(lower(TEXT), 'n[''’]t\b', ' not', 'g'), '([\p{L}\p{N}]+)-free\b', 'no \1', 'g'), 'ENDS'), lambda k: regexp_extract_all(k, '[\p{L}\p{N}_]+'))".replace("ENDS", L.CLAUSE)


def _scopes(clauses, kind):
    after, before = f"list_filter(k[i + 1:i + 6], {_KEEP})", f"list_filter(k[greatest(i - 6, 1):i - 1], {_KEEP})"
    return f"flatten(list_transform({clauses}, lambda k: list_filter(list_transform(k, lambda x, i: CASE WHEN x IN ({_in(kind)}) THEN CASE WHEN len({after}) > 0 THEN {after} ELSE {before} END END), lambda s: len(s) > 0)))"


def _lost(denied, stated, kept):
    same = "(x = y OR (length(y) >= 4 AND starts_with(x, y)) OR (length(x) >= 4 AND starts_with(y, x)))"
    hits = f"len(list_filter(s, lambda x: len(list_filter({stated}, lambda y: {same})) > 0))"
    meets = f"len(list_filter(flatten({kept}), lambda y: len(list_filter(s, lambda x: {same})) > 0))"
    return f"len(list_filter({denied}, lambda s: {hits} >= least(2, len(s)) AND {meets} = 0)) > 0"


_NAMED = rf"""regexp_matches(x, '{L.NAMED}') OR (i > 1 AND NOT regexp_matches(raw[i - 1], '[.!?:;]$') AND regexp_matches(x, '^\p{{Lu}}\p{{Ll}}+$'))"""


@operator(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
ab AS (SELECT doc_id, array_to_string(w[1:4], ' ') AS a, array_to_string(w[5:9], ' ') AS b FROM w WHERE len(w) >= 9), t AS (SELECT doc_id, {_CLAIM} AS claim, {_QUOTE} AS quote FROM ab),
c AS (SELECT *, {_CLAUSES.replace('TEXT', 'claim')} AS cc, {_CLAUSES.replace('TEXT', 'quote')} AS qc, regexp_split_to_array(claim, '\s+') AS raw, list_transform(regexp_split_to_array(lower(quote), '\s+'), lambda x: regexp_replace(x, '{L.EDGES}', '', 'g')) AS held FROM t),
s AS (SELECT *, {_scopes('cc', L.NEGATIONS)} AS cn, {_scopes('qc', L.NEGATIONS)} AS qn, {_scopes('cc', L.HEDGES)} AS ch, {_scopes('qc', L.HEDGES)} AS qh, list_filter(flatten(cc), {_KEEP}) AS cw, list_filter(flatten(qc), {_KEEP}) AS qw,
  list_filter(list_transform(raw, lambda x: regexp_replace(x, '{L.EDGES}', '', 'g')), lambda x, i: {_NAMED}) AS named FROM c),
u AS (SELECT *, list_filter(named, lambda x: NOT list_contains(held, lower(x))) AS missing FROM s)
SELECT doc_id, CASE WHEN {_lost('qn', 'cw', 'cn')} THEN 'dropped' WHEN {_lost('cn', 'qw', 'qn')} THEN 'inserted' WHEN {_lost('qh', 'cw', 'ch')} THEN 'hardened' ELSE 'kept' END AS polarity,
  array_to_string(list_sort(list_distinct(named)), ' ') AS named, array_to_string(list_sort(list_distinct(missing)), ' ') AS missing FROM u""")
def claim_polarity(spark, sf):
    """H1.25: claims that drop or add a denial or a hedge of their quotes, and the subjects they name that no quote names."""
    w = table(spark, sf, "documents").select("doc_id", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "").alias("w")).where(F.size("w") >= 9)
    t = w.select("doc_id", F.array_join(F.slice("w", 1, 4), " ").alias("a"), F.array_join(F.slice("w", 5, 5), " ").alias("b")).select("doc_id", F.expr(_CLAIM).alias("claim"), F.expr(_QUOTE).alias("quote"))
    line = lambda x: F.array_join(F.array_sort(x), " ")
    return L.judged(t, "claim", "quote").select("doc_id", "polarity", line(L.subjects(F.col("claim"))).alias("named"), line(L.unattributed(F.col("claim"), F.col("quote"))).alias("missing"))
