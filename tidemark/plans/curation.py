"""Writing, curating and checking items: declared supersession, lessons, batches, reopening, relation guards, migration checks, staged bundles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import predicates as P
from tidemark.operators import curation as C
from tidemark.operators.sizes import parts
from tidemark.plans.registry import operator
from tidemark.session import stored
from tidemark.sources.model import VERSIONS, versions
from tidemark.sources.tables import table
from tidemark.streaming import jobs

# each document's row has a number of its own, however many documents there are
_SAY = """CASE doc_id % 12 WHEN 0 THEN 'This document supersedes docs/' || (doc_id - 1) || '.md and ./' || (doc_id - 2) || '.md.' WHEN 1 THEN 'It does not supersede or replaces docs/' || (doc_id - 1) || '.md.'
  WHEN 2 THEN '```' || chr(10) || 'This document supersedes docs/' || (doc_id - 1) || '.md' || chr(10) || '```' WHEN 3 THEN '> supersedes docs/' || (doc_id - 1) || '.md' WHEN 4 THEN 'Dieses Dokument wurde ersetzt durch "Title ' || (doc_id - 4) || '".'
  WHEN 5 THEN 'D-' || (1000 + doc_id) || ' | open | replaces docs/' || (doc_id - 5) || '.md' WHEN 6 THEN 'Note: D-' || (1000 + doc_id - 1) || ' is superseded by docs/' || (doc_id - 3) || '.md.' WHEN 7 THEN 'This document supersedes docs/nowhere.md.'
  WHEN 8 THEN 'Replaces D-' || (1000 + doc_id - 3) || '.' WHEN 9 THEN 'The other page replaces docs/' || (doc_id - 1) || '.md.' WHEN 10 THEN 'This document replaces "Twice".' ELSE 'This page supersedes docs/' || doc_id || '.md section 2.' END"""
_SAID = """e AS (SELECT doc_id, doc_id % 12 AS c FROM documents), k AS (SELECT doc_id, c, unnest(CASE c WHEN 0 THEN [0, 1] ELSE [0] END) AS k FROM e WHERE c NOT IN (1, 2, 3)),
o AS (SELECT doc_id, k, c, CASE c WHEN 4 THEN 'superseded_by' WHEN 6 THEN 'superseded_by' WHEN 0 THEN 'supersedes' WHEN 7 THEN 'supersedes' WHEN 11 THEN 'supersedes' ELSE 'replaces' END AS marker,
  CASE c WHEN 0 THEN doc_id - 1 - k WHEN 4 THEN doc_id - 4 WHEN 5 THEN doc_id - 5 WHEN 6 THEN doc_id - 3 WHEN 8 THEN doc_id - 3 WHEN 9 THEN doc_id - 1 WHEN 11 THEN doc_id END AS target, CASE c WHEN 6 THEN doc_id - 1 ELSE doc_id END AS own FROM k),
x AS (SELECT o.*, CASE WHEN c = 7 THEN 'unknown-target' WHEN c = 10 THEN CASE WHEN (SELECT count(*) FROM documents WHERE doc_id % 12 = 3) > 1 THEN 'ambiguous-target' ELSE 'unknown-target' END WHEN target NOT IN (SELECT doc_id FROM documents) THEN 'unknown-target'
  WHEN c = 9 THEN 'no-subject' WHEN c = 8 THEN 'row-by-text' WHEN c = 11 THEN 'self' ELSE 'link' END AS outcome FROM o)"""


@operator(f"""WITH {_SAID} SELECT doc_id AS key, CAST(0 AS INTEGER) AS n, CAST(k AS INTEGER) AS k, marker, CASE WHEN outcome = 'link' THEN CASE WHEN c IN (4, 6) THEN target ELSE own END END AS newer, CASE WHEN outcome = 'link' THEN CASE WHEN c IN (4, 6) THEN own ELSE target END END AS older,
CASE WHEN outcome = 'link' THEN CASE WHEN c IN (5, 6) THEN 'part' ELSE 'whole' END END AS scope, outcome FROM x""")
def declarations(spark, sf):
    """H1.23, H1.28, C24: what notes filed with the documents declare superseded, outside fences, quotes, denials; resolved by path, title or decision row where one item has it, else why not."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 12 == 3, "Twice").otherwise(F.concat(F.lit("Title "), F.col("doc_id").cast("string"))).alias("title"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(_SAY)).alias("body"))
    return C.resolve(C.declarations(d), d)


@operator("""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS t FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
b AS (SELECT doc_id, i, CASE i % 3 WHEN 1 THEN 'mistake' WHEN 2 THEN 'fix' ELSE 'context' END AS role, trim(t, ' ') AS t FROM l),
r AS (SELECT *, count(*) FILTER (role = 'mistake') OVER (PARTITION BY doc_id ORDER BY i) AS rule FROM b)
SELECT doc_id, rule, max(t) FILTER (role = 'mistake') AS mistake, max(t) FILTER (role = 'fix') AS fix, max(t) FILTER (role = 'context') AS context FROM r GROUP BY doc_id, rule""")
def lesson_split(spark, sf):
    """H1.34, L6: one rule for each bullet that names a mistake, with the fix and the context that follow it."""
    labels = F.array(F.lit("- Mistake: "), F.lit("- Fix: "), F.lit("* context: "))
    made = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(labels, (i % 3 + 1).cast("int")), x))
    return C.lessons(table(spark, sf, "documents").select("doc_id", F.array_join(made, "\n").alias("body")), "doc_id", "body")


@operator(f"""WITH {VERSIONS}, n AS (SELECT *, lead(version_id) OVER line AS next_id, lead(superseded_at) OVER line AS next_end, lag(superseded_at) OVER line AS prev_end, lag(weight) OVER line AS prev_weight FROM versions WINDOW line AS (PARTITION BY logical_id ORDER BY valid_from, version_id)),
f AS (SELECT *, superseded_at IS NOT NULL AND weight > 250000 AS asked, superseded_at IS NOT NULL AND weight > 250000 AND next_end IS NULL AS undo, prev_end IS NOT NULL AND prev_weight > 250000 AND superseded_at IS NULL AS gone FROM n)
SELECT version_id, logical_id, CASE WHEN gone THEN 'withdrawn' WHEN asked AND NOT undo THEN 'refused' ELSE 'kept' END AS op, recorded_at, CASE WHEN gone THEN TIMESTAMP '2030-01-01' ELSE superseded_at END AS superseded_at FROM f
UNION ALL SELECT version_id, logical_id, 'restored', TIMESTAMP '2030-01-01', NULL FROM f WHERE undo""")
def reopen(spark, sf):
    """K5: supersessions taken back: the closed row comes back as a copy and its successor ends, if nothing came after that."""
    return C.reopen(versions(spark, sf), F.col("weight") > 250000, F.lit("2030-01-01").cast("timestamp_ntz"))


_WRITES = """w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS body, lag(l_returnflag) OVER k AS before FROM lineitem WINDOW k AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber)),
a AS (SELECT *, CASE WHEN before IS NULL THEN 'insert' WHEN before = body THEN 'noop' ELSE 'update' END AS action FROM w)"""


@operator(f"WITH {_WRITES} SELECT l_orderkey, l_linenumber, action, CAST(sum(CASE WHEN action = 'noop' THEN 0 ELSE 1 END) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS BIGINT) AS version FROM a")
def write_batch(spark, sf):
    """Items written in order: new, changed or the same as the item's last version, with the version each leaves."""
    return C.actions(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"], F.col("l_returnflag")).select("l_orderkey", "l_linenumber", "action", "version")


@operator(f"WITH {_WRITES} SELECT l_orderkey, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (action = 'insert') AS BIGINT) AS inserted, CAST(count(*) FILTER (action = 'update') AS BIGINT) AS updated, CASE WHEN count(*) > 5 THEN 'too-many' WHEN count(*) = count(*) FILTER (action = 'noop') THEN 'replayed' ELSE 'closed' END AS state FROM a GROUP BY l_orderkey")
def call_the_day(spark, sf):
    """L4: a session's batch as a whole: its size held to a limit, what it changed, and whether it only repeats what was there."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    p = parts(li.count(), spark)
    a = C.actions(li.repartition(p, "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"], F.col("l_returnflag"))
    a = a.select("l_orderkey", "action").repartition(p, "l_orderkey")
    n = lambda x: F.count_if(F.col("action") == x)
    g = a.groupBy("l_orderkey").agg(F.count("*").alias("items"), n("insert").alias("inserted"), n("update").alias("updated"), n("noop").alias("same"))
    return g.select("l_orderkey", "items", "inserted", "updated", F.when(F.col("items") > 5, "too-many").when(F.col("items") == F.col("same"), "replayed").otherwise("closed").alias("state"))


_W = r"[\p{L}\p{N}_]+"


# turns as they are, that repeat the one before, that change a number in it, or that keep most of it and add one
_NEW = "CASE (conv_id + turn) % 5 WHEN 1 THEN before WHEN 2 THEN before || ' 41' WHEN 3 THEN substr(before, 1, CAST(length(before) * 2 / 3 AS INT)) || ' 12' ELSE text END"
_OLD = "CASE (conv_id + turn) % 5 WHEN 2 THEN before || ' 40' ELSE before END"


@operator(rf"""WITH r AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), t AS (SELECT conv_id, turn, {_NEW} AS text, {_OLD} AS before FROM r),
s AS (SELECT conv_id, turn, text, before, list_distinct(regexp_extract_all(lower(text), '{_W}')) AS a, list_distinct(regexp_extract_all(lower(before), '{_W}')) AS b, list_distinct(regexp_extract_all(text, '[0-9]+')) AS x, list_distinct(regexp_extract_all(before, '[0-9]+')) AS y FROM t WHERE before IS NOT NULL AND text IS NOT NULL),
j AS (SELECT *, len(list_intersect(a, b)) AS c, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS more, len(list_filter(y, lambda v: NOT list_contains(x, v))) AS less FROM s)
SELECT conv_id, turn, CASE WHEN more > 0 AND less > 0 THEN 'dropped' WHEN text = before THEN 'duplicate' WHEN 100 * c >= 90 * (len(a) + len(b) - c) THEN 'relates' WHEN 2 * c >= len(b) AND more > 0 THEN 'refines' ELSE 'relates' END AS relation,
  CASE WHEN more > 0 AND less > 0 THEN 'none' WHEN text = before THEN 'auto' WHEN 2 * c >= len(b) THEN 'question' ELSE 'ledger' END AS tier FROM j""")
def relation_guards(spark, sf):
    """What rules leave of a judged relation of two texts, and whether it acts by itself, asks, or is only kept."""
    # the SQL's cast to a whole number rounds, Spark's cuts
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w)).select("conv_id", "turn", F.expr(_NEW.replace("CAST(length(before) * 2 / 3 AS INT)", "CAST(round(length(before) * 2 / 3) AS INT)")).alias("new"), F.expr(_OLD).alias("old"))
    return C.relations(t.where("old IS NOT NULL AND new IS NOT NULL"), ["conv_id", "turn"])


@operator("""WITH s AS (SELECT doc_id, CAST(doc_id // 100 AS BIGINT) AS batch, sha256(coalesce(text, '')) AS sent FROM documents), r AS (SELECT doc_id, sha256(CASE WHEN n_chars > 3000 THEN left(text, 3000) ELSE coalesce(text, '') END) AS stored FROM documents WHERE lang <> 'es' OR n_chars < 2000)
SELECT batch, CAST(count(*) AS BIGINT) AS sent, CAST(count(*) FILTER (sent = stored) AS BIGINT) AS equal, CAST(count(*) FILTER (sent <> stored) AS BIGINT) AS altered, CAST(count(*) FILTER (stored IS NULL) AS BIGINT) AS missing, sha256(string_agg(sent, '' ORDER BY doc_id)) AS seal FROM s LEFT JOIN r USING (doc_id) GROUP BY batch""")
def migration_check(spark, sf):
    """What was sent held against what was stored, by digest, in batches of a hundred ids, each sealed. The stored side has planted losses."""
    d = table(spark, sf, "documents")
    kept = F.when(F.col("n_chars") > 3000, F.left("text", F.lit(3000))).otherwise(F.col("text"))
    there = stored(d.where("lang <> 'es' OR n_chars < 2000").select("doc_id", kept.alias("text")))
    return C.round_trip(d, there, "doc_id", "text", 100)


@operator("""WITH e AS (SELECT doc_id, source, md5(text) AS digest, length(text) AS n FROM documents WHERE text IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id) > 1 AS again FROM e)
SELECT source, CAST(count(*) AS BIGINT) AS exported, CAST(count(*) FILTER (again) AS BIGINT) AS duplicates, CAST(count(*) FILTER (NOT again AND n < 200) AS BIGINT) AS refused, CAST(count(*) FILTER (NOT again AND n >= 200) AS BIGINT) AS bundled FROM f GROUP BY source""")
def curation_bundle(spark, sf):
    """Export, candidates, gate and bundle as stages, each a table that a later run takes up instead of making it again."""
    run = C.Stages(spark)
    out = run.stage("export", lambda: table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("n")))
    first = run.stage("candidates", lambda: out.groupBy("digest").agg(F.min("doc_id").alias("first")))
    gate = run.stage("gate", lambda: out.join(first, "digest").select("doc_id", "source", P.first_reason((F.col("doc_id") != F.col("first"), "duplicate"), (F.col("n") < 200, "refused")).alias("reason")))
    n = lambda x: F.count_if(F.col("reason") == x)
    return run.stage("bundle", lambda: gate.groupBy("source").agg(F.count("*").alias("exported"), n("duplicate").alias("duplicates"), n("refused").alias("refused"), F.count_if(F.col("reason").isNull()).alias("bundled")))


@operator("""WITH c AS (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'R') AS gold, bool_or(l_quantity > 25) AS said FROM lineitem GROUP BY ALL), n AS (SELECT l_orderkey, count(*) FILTER (gold AND said) AS hit, count(*) FILTER (gold) AS g, count(*) FILTER (said) AS s FROM c GROUP BY l_orderkey)
SELECT l_orderkey, g = 0 AS negative, CASE WHEN g + s = 0 THEN 1.0 ELSE round(2.0 * hit / (g + s), 6) END AS f1, CASE WHEN g + s = 0 THEN 1.0 ELSE round(1.0 * hit / (g + s - hit), 6) END AS jaccard, CASE WHEN g = 0 THEN s = 0 ELSE hit > 0 END AS correct FROM n""")
def task_scores(spark, sf):
    """H3.20: a case's answers held against its gold set: F1, Jaccard, and whether it was right to abstain where nothing is gold."""
    c = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("gold"), F.bool_or(F.col("l_quantity") > 25).alias("said"))
    return C.set_scores(c, "l_orderkey")


@operator("""WITH e AS (SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER w AS refreshed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, min(CASE WHEN event_type <> 'purchase' THEN ts END) OVER (PARTITION BY user_id, refreshed ORDER BY ts, event_id) AS unseen FROM e)
SELECT event_id, CASE WHEN refreshed IS NULL THEN 'cold' WHEN unseen IS NULL THEN 'fresh' WHEN epoch(ts) - epoch(unseen) <= 300 THEN 'fresh' WHEN epoch(ts) - epoch(unseen) <= 1800 THEN 'refreshing' ELSE 'unfiltered' END AS state FROM f""")
def stats_staleness(spark, sf):
    """Whether statistics may still be used at each read: for a while after the first write they haven't seen, somewhat longer while they are renewed, then not."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    refresh = F.when(F.col("event_type") == "purchase", F.col("ts"))
    e = table(spark, sf, "events").withColumn("refreshed", F.last(refresh, ignorenulls=True).over(w))
    unseen = F.min(F.when(F.col("event_type") != "purchase", F.col("ts"))).over(Window.partitionBy("user_id", "refreshed").orderBy("ts", "event_id"))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(unseen.cast("timestamp"))
    state = F.when(F.col("refreshed").isNull(), "cold").when(F.coalesce(age, F.lit(0)) <= 300_000_000, "fresh").when(age <= 1_800_000_000, "refreshing").otherwise("unfiltered")
    return e.select("event_id", state.alias("state"))


_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 30 MINUTE FROM events)"


@operator(f"""WITH e AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE]) AS start FROM events)
SELECT start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS spent FROM e WHERE start + INTERVAL 30 MINUTE <= {_CLOSED} GROUP BY ALL""")
def stream_sliding(spark, sf):
    """I16: half-hour windows that begin each quarter of an hour, given out once the watermark has passed them."""
    return jobs.run(jobs.sliding(jobs.source(spark, sf)))


@operator(f"""WITH e AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 20 MINUTE, true) AS fresh FROM events),
s AS (SELECT user_id, ts, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) AS last, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 20 MINUTE <= {_CLOSED}""")
def stream_sessions(spark, sf):
    """I16: a user's sessions, ended by twenty quiet minutes and given out once the watermark has passed them."""
    return jobs.run(jobs.sessions(jobs.source(spark, sf)))


@operator("SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g'), ' ') AS key FROM orders")
def sql_function(spark, sf):
    """M1: a function in SQL, made for the session and called from a query."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemark_key(s STRING) RETURNS STRING RETURN trim(regexp_replace(lower(s), '[^a-z0-9]+', ' '))")
    return table(spark, sf, "orders").selectExpr("o_orderkey", "tidemark_key(o_orderpriority) AS key")
