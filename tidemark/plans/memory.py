"""Version maintenance and the composite services: guards, lifecycles, export, memory map, briefs, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import predicates as P
from tidemark.operators import retrieval as R
from tidemark.operators.ranks import running
from tidemark.plans.registry import operator
from tidemark.sources.model import VERSIONS, versions
from tidemark.sources.tables import table


@operator(f"""WITH {VERSIONS}, u AS (SELECT *, version_id % 97 AS want FROM versions WHERE superseded_at IS NULL) SELECT version_id, CASE WHEN want = 0 THEN 'not-found' WHEN status = 'P' THEN 'not-active' WHEN device_scope = 'all' AND want % 5 = 1 THEN 'widens' WHEN valid_to IS NOT NULL THEN 'not-head' WHEN weight > 300000 THEN 'too-large' END AS reason FROM u""")
def update_guards(spark, sf):
    """The first guard that refuses an update."""
    want = F.col("version_id") % 97
    r = P.first_reason((want == 0, "not-found"), (F.col("status") == "P", "not-active"), ((F.col("device_scope") == "all") & (want % 5 == 1), "widens"), (F.col("valid_to").isNotNull(), "not-head"), (F.col("weight") > 300000, "too-large"))
    return versions(spark, sf).where("superseded_at IS NULL").select("version_id", r.alias("reason"))


@operator("WITH l AS (SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey AS id, l_linenumber AS n FROM lineitem), x AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY id, n) AS rn FROM l), p AS (SELECT DISTINCT src, dst FROM l) SELECT x.id, x.n, CASE WHEN x.src = x.dst THEN 'self' WHEN rn > 1 THEN 'duplicate' WHEN p.src IS NOT NULL THEN 'both-directions' END AS reason FROM x LEFT JOIN p ON p.src = x.dst AND p.dst = x.src")
def link_gate(spark, sf):
    """Links that are refused, with the reason."""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"))
    back = l.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")).distinct()
    x = l.withColumn("rn", F.row_number().over(Window.partitionBy("src", "dst").orderBy("id", "n"))).join(back, ["src", "dst"], "left")
    return x.select("id", "n", P.first_reason((F.col("src") == F.col("dst"), "self"), (F.col("rn") > 1, "duplicate"), (F.col("back"), "both-directions")).alias("reason"))


@operator("WITH q AS (SELECT user_id, arg_max(event_type, event_id) AS last, min(ts) AS opened FROM events GROUP BY user_id) SELECT user_id, CASE WHEN last = 'purchase' THEN 'applied' WHEN last = 'error' THEN 'rejected' WHEN last = 'signup' THEN 'approved' WHEN opened < TIMESTAMP '2024-01-01 12:00:00' THEN 'expired' ELSE 'open' END AS state FROM q")
def question_lifecycle(spark, sf):
    """The state of each question by its last event, or expired."""
    q = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.min("ts").alias("opened"))
    l = F.col("last")
    state = F.when(l == "purchase", "applied").when(l == "error", "rejected").when(l == "signup", "approved").when(F.col("opened") < F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), "expired").otherwise("open")
    return q.select("user_id", state.alias("state"))


@operator("SELECT doc_id, md5(text) AS digest, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) > 1 AS closed FROM documents")
def close_duplicates(spark, sf):
    """The newest of equal bodies stays."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    newest = d.groupBy("digest").agg(F.max("doc_id").alias("newest")).withColumnRenamed("digest", "g")
    return d.join(newest, d["digest"].eqNullSafe(newest["g"])).select("doc_id", "digest", (F.col("doc_id") < F.col("newest")).alias("closed"))


@operator("SELECT user_id, max(ts) AS last_access_at, CAST(count(*) AS BIGINT) AS touches FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def last_access_fold(spark, sf):
    """The greatest access time."""
    return table(spark, sf, "events").where("event_type IN ('view', 'click')").groupBy("user_id").agg(F.max("ts").alias("last_access_at"), F.count("*").alias("touches"))


@operator("SELECT o_custkey, o_orderkey, CAST(10000 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS new_id FROM orders")
def dense_ids(spark, sf):
    """H3.16: dense ids inside a project."""
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 10000).cast("long").alias("new_id"))


@operator(f"WITH {VERSIONS}, x AS (SELECT * FROM versions WHERE list_contains(project_ids, 27) AND valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR TIMESTAMP '1996-06-01' < valid_to)), p AS (SELECT logical_id, version_id, sum(1 + importance) OVER (ORDER BY logical_id, version_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM x WHERE (logical_id, version_id) > (200, 0) ORDER BY logical_id, version_id LIMIT 100)) SELECT logical_id, version_id, CAST(used AS BIGINT) AS used FROM p WHERE used <= 300")
def export_page(spark, sf):
    """A page after a cursor at a frozen instant, packed under a budget."""
    at = F.lit("1996-06-01").cast("timestamp_ntz")
    x = versions(spark, sf).where(F.array_contains("project_ids", 27) & P.since_until(F.col("valid_from"), F.col("valid_to"), at))
    page = x.where(F.struct("logical_id", "version_id") > F.struct(F.lit(200).cast("long"), F.lit(0).cast("long"))).orderBy("logical_id", "version_id").limit(100)
    page = page.select("logical_id", "version_id", (F.col("importance") + 1).alias("cost"), F.lit(1).alias("one"))
    return R.pack_prefix(page, ["one"], [F.col("logical_id"), F.col("version_id")], "cost", 300).select("logical_id", "version_id", "used")


@operator("WITH e AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS rn FROM documents), c AS (SELECT source, lang, count(*) AS total, sum(n_chars) AS size FROM documents GROUP BY ALL), t AS (SELECT e.source, e.lang, e.doc_id, e.rn, total, sum(length(e.source) + 10) OVER (PARTITION BY e.lang ORDER BY rn, size DESC, e.source ROWS UNBOUNDED PRECEDING) AS used FROM e JOIN c USING (source, lang) WHERE rn <= 10) SELECT source, lang, doc_id, CAST(total AS BIGINT) AS total, CAST(used AS BIGINT) AS used FROM t WHERE used <= 600")
def memory_map_entries(spark, sf):
    """Sections in turn, larger ones first, newest entries, under a budget."""
    d = table(spark, sf, "documents")
    c = d.groupBy("source", "lang").agg(F.count("*").alias("total"), F.sum("n_chars").alias("size"))
    e = R.top_k(d.select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id").desc()], 10).join(c, ["source", "lang"])
    e = e.withColumn("cost", F.length("source") + 10)
    return R.pack_prefix(e, ["lang"], [F.col("rank"), F.col("size").desc(), F.col("source")], "cost", 600).select("source", "lang", "doc_id", "total", "used")


@operator(f"WITH {VERSIONS}, s AS (SELECT CASE WHEN kind IN ('1-URGENT', '2-HIGH') THEN 'decision' WHEN kind = '3-MEDIUM' THEN 'lesson' ELSE 'pending' END AS section, version_id, importance, weight FROM versions WHERE valid_to IS NULL AND superseded_at IS NULL), t AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY importance DESC, weight DESC, version_id) AS rn FROM s) SELECT section, version_id, CAST(rn AS INTEGER) AS place FROM t WHERE rn <= 12")
def brief_sections(spark, sf):
    """The first items of each section of a brief."""
    k = F.col("kind")
    section = F.when(k.isin("1-URGENT", "2-HIGH"), "decision").when(k == "3-MEDIUM", "lesson").otherwise("pending")
    v = versions(spark, sf).where("valid_to IS NULL AND superseded_at IS NULL").select(section.alias("section"), "version_id", "importance", "weight")
    return R.top_k(v, ["section"], [F.col("importance").desc(), F.col("weight").desc(), F.col("version_id")], 12).select("section", "version_id", F.col("rank").alias("place"))


@operator("WITH b AS (SELECT l_suppkey AS model, l_returnflag AS task, avg(l_discount * 10) AS score, sum(l_extendedprice) AS cost FROM lineitem GROUP BY ALL), m AS (SELECT model, avg(score) AS macro, sum(cost) AS cost, count(*) AS tasks FROM b GROUP BY model) SELECT model, round(macro, 6) AS macro, round(cost, 2) AS cost, CAST(rank() OVER (ORDER BY round(macro, 6) DESC) AS INTEGER) AS place FROM m WHERE tasks = 3")
def leaderboard(spark, sf):
    """Macro means over tasks, ranked; a row for each model."""
    b = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model"), "l_returnflag").agg(F.avg(F.col("l_discount") * 10).alias("score"), F.sum("l_extendedprice").alias("cost"))
    m = b.groupBy("model").agg(F.round(F.avg("score"), 6).alias("macro"), F.round(F.sum("cost"), 2).alias("cost"), F.count("*").alias("tasks")).where("tasks = 3")
    m = running(m, [], [F.col("macro").desc(), F.col("model")])  # ranges of the order, not one task
    place = F.min("row_no").over(Window.partitionBy("macro"))
    return m.select("model", "macro", "cost", place.cast("int").alias("place"))


@operator("SELECT event_type, CAST(count(*) AS BIGINT) AS n, min(ts) AS oldest, CAST(count(DISTINCT user_id) AS BIGINT) AS devices, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, CAST(count(*) FILTER (user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')) AS BIGINT) AS orphans FROM events GROUP BY event_type")
def ops_status(spark, sf):
    """Counts, ages and orphans by state."""
    e = table(spark, sf, "events")
    s = e.where("event_type = 'signup'").select("user_id").distinct().withColumn("known", F.lit(True))
    return e.join(s, "user_id", "left").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.countDistinct("user_id").alias("devices"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.count_if(F.col("known").isNull()).alias("orphans"))


@operator(f"WITH {VERSIONS} SELECT v.version_id, n.version_id AS superseded_by, v.recorded_at, v.superseded_at, n.valid_from <= v.valid_from AS contains_start FROM versions v LEFT JOIN (SELECT *, lag(version_id) OVER (PARTITION BY logical_id ORDER BY valid_from, version_id) AS prev FROM versions) n ON n.prev = v.version_id")
def raw_provenance(spark, sf):
    """Each version with the one that follows it."""
    w = Window.partitionBy("logical_id").orderBy("valid_from", "version_id")
    v = versions(spark, sf)
    return v.select("version_id", F.lead("version_id").over(w).alias("superseded_by"), "recorded_at", "superseded_at", (F.lead("valid_from").over(w) <= F.col("valid_from")).alias("contains_start"))


@operator("SELECT e.vec_id AS subject, n.v AS candidate, n.sim, CAST(n.rk AS INTEGER) AS rank FROM embeddings e JOIN (SELECT a.vec_id AS q, b.vec_id AS v, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) DESC, b.vec_id) AS rk FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) n ON n.q = e.vec_id WHERE rk <= 8 AND sim >= 0.2")
def candidate_selection(spark, sf):
    """Candidates of new items: the eight nearest, weak ones dropped."""
    e = table(spark, sf, "embeddings")
    t = R.cosine_top(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), e, 8)
    return t.where("sim >= 0.2").select(F.col("q").alias("subject"), F.col("v").alias("candidate"), "sim", "rank")
