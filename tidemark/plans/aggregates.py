"""Aggregations and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import evaluation as E
from tidemark.operators.quantiles import percentile_exact
from tidemark.plans.registry import operator
from tidemark.sources.tables import table

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def toks(c):
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def doc_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(toks(F.col("text")))).alias("tok"))


_DT = f"dt AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS tok FROM documents)"


@operator(f"WITH {_DT} SELECT tok, CAST(count(*) AS BIGINT) AS df FROM dt GROUP BY tok")
def df_table(spark, sf):
    """D3: document frequency of every token."""
    return doc_terms(spark, sf).groupBy("tok").agg(F.count("*").alias("df"))


@operator(f"WITH {_DT}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT tok, count(*) AS df FROM dt GROUP BY tok) SELECT left(tok, 3) AS prefix, CAST(least(max(n), sum(df)) AS BIGINT) AS df FROM df, n WHERE length(tok) >= 3 GROUP BY 1")
def prefix_df(spark, sf):
    """Document frequencies summed by prefix, capped at the number of documents."""
    n = table(spark, sf, "documents").agg(F.count("*").alias("n"))
    df = doc_terms(spark, sf).where(F.length("tok") >= 3).groupBy(F.substring("tok", 1, 3).alias("prefix")).agg(F.count("*").alias("s"))
    return df.crossJoin(F.broadcast(n)).select("prefix", F.least("n", "s").alias("df"))


@operator("SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS priorities, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_f FROM orders GROUP BY o_custkey")
def listagg_slugs(spark, sf):
    """Ordered string aggregation."""
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.expr("listagg(o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderkey)").alias("priorities"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))


@operator("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (value > 50) AS BIGINT) AS big, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(DISTINCT user_id) FILTER (value > 50) AS BIGINT) AS big_users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def status_counts_filter(spark, sf):
    """Counts and distinct counts with filters, and first and last instants."""
    big = F.when(F.col("value") > 50, F.col("user_id"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("big"), F.countDistinct("user_id").alias("users"), F.countDistinct(big).alias("big_users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@operator("SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' AND event_type = 'signup' THEN 'expired' ELSE event_type END AS state, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN value > 10 THEN value ELSE 0 END), 4) AS spent FROM events GROUP BY 1")
def computed_key(spark, sf):
    """A group key with expiry folded in, and conditional sums."""
    state = F.when((F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")) & (F.col("event_type") == "signup"), "expired").otherwise(F.col("event_type"))
    return table(spark, sf, "events").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("value") > 10, F.col("value")).otherwise(0.0)), 4).alias("spent"))


@operator("SELECT l_returnflag, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice) AS p95, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS c95, min(l_extendedprice) AS low, max(l_extendedprice) AS high, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
def percentiles(spark, sf):
    """Discrete, interpolated, and a distribution summary; a flag's rows are never sorted in one task."""
    li = table(spark, sf, "lineitem")
    q = percentile_exact(li, ["l_returnflag"], "l_extendedprice", [0.5, 0.95]).groupBy("l_returnflag").agg(
        F.max(F.when(F.col("share") == 0.95, F.col("disc"))).alias("p95"), F.max(F.when(F.col("share") == 0.5, F.col("disc"))).alias("p50"), F.round(F.max(F.when(F.col("share") == 0.95, F.col("cont"))), 6).alias("c95")
    )
    rest = li.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count("*").alias("n"))
    return q.join(rest, "l_returnflag").select("l_returnflag", "p95", "p50", "c95", "low", "high", "n")


_RUN = "r AS (SELECT l_returnflag AS task, l_linestatus AS tier, l_linenumber AS rep, l_discount * 10 AS score, l_quantity AS latency, l_extendedprice AS cost FROM lineitem)"


def run_rows(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("tier"), F.col("l_linenumber").alias("rep"), (F.col("l_discount") * 10).alias("score"), F.col("l_quantity").alias("latency"), F.col("l_extendedprice").alias("cost"))


@operator(f"""WITH {_RUN}, m AS (SELECT task, tier, rep, avg(score) AS m FROM r GROUP BY ALL), x AS (SELECT task, tier, min(m) AS worst_rep, stddev_pop(m) AS rep_sd FROM m GROUP BY ALL)
SELECT r.task, r.tier, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS correct, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency) AS p95,
round(sum(cost), 2) AS cost, round(sum(cost) / nullif(count(*) FILTER (score >= 0.5), 0), 4) AS cost_per_correct, round(max(worst_rep), 6) AS worst_rep, round(max(rep_sd), 6) AS rep_sd FROM r JOIN x ON r.task = x.task AND r.tier = x.tier GROUP BY r.task, r.tier""")
def group_stats(spark, sf):
    """Statistics of runs by task and tier."""
    r = E.run_stats(run_rows(spark, sf), ["task", "tier"], "rep", "score", "latency", "cost")
    return r.select("task", "tier", "n", *(F.round(c, 6).alias(c) for c in ("mean", "correct", "worst_rep", "rep_sd")), "p50", "p95", F.round("cost", 2).alias("cost"), F.round("cost_per_correct", 4).alias("cost_per_correct"))


@operator(f"WITH {_RUN} SELECT task, tier, CAST(grouping(task) * 2 + grouping(tier) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean, round(sum(cost), 2) AS cost FROM r GROUP BY GROUPING SETS ((), (task), (tier), (task, tier))")
def rollup_levels(spark, sf):
    """All levels in one pass by grouping sets."""
    r = run_rows(spark, sf)
    return r.groupingSets([[], ["task"], ["tier"], ["task", "tier"]], "task", "tier").agg(F.grouping_id("task", "tier").cast("long").alias("level"), F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.sum("cost"), 2).alias("cost"))


@operator("SELECT lang, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS toxic_rate, round(avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END), 6) AS low_rate, round(avg(CASE WHEN quality = 0 AND toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS both_rate, CAST(count(*) AS BIGINT) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def error_rates(spark, sf):
    """Rates as averages of conditions."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rate = lambda c, n: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(n)
    t, q = F.col("toxic") == 1, F.col("quality") == 0
    return j.groupBy("lang").agg(rate(t, "toxic_rate"), rate(q, "low_rate"), rate(q & t, "both_rate"), F.count("*").alias("n"))


@operator("""WITH p AS (SELECT l_suppkey % 20 AS g, CAST(count(*) FILTER (l_quantity > 45 AND l_discount < 0.02) AS BIGINT) AS b, CAST(count(*) FILTER (l_quantity < 3 AND l_discount > 0.07) AS BIGINT) AS c FROM lineitem GROUP BY 1)
SELECT g, b, c, round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2.0))) FROM unnest(range(0, least(b, c) + 1)) AS u(i))), 6) AS p_value FROM p""")
def mcnemar_exact(spark, sf):
    """The exact test of discordant counts by group."""
    x = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("g")).agg(F.count_if(F.expr("l_quantity > 45 AND l_discount < 0.02")).alias("b"), F.count_if(F.expr("l_quantity < 3 AND l_discount > 0.07")).alias("c"))
    return x.select("g", "b", "c", F.round(E.mcnemar(F.col("b"), F.col("c")), 6).alias("p_value"))


_NEAR = "SELECT a.vec_id AS q, b.vec_id AS v, a.label = b.label AS hit, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0"


@operator(f"WITH s AS ({_NEAR}), r AS (SELECT q, min(rk) FILTER (hit) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, v) AS rk FROM s) WHERE rk <= 10 GROUP BY q) SELECT q % 3 AS slice, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr FROM r GROUP BY 1")
def hit_at_k_mrr(spark, sf):
    """Rank metrics of nearest neighbours with the query's label, by slice."""
    from tidemark.operators.retrieval import cosine_top

    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.col("label").alias("ql"))
    top = cosine_top(q, e, 10)
    r = top.join(q.select("q", "ql"), "q").join(e.select(F.col("vec_id").alias("v"), "label"), "v").groupBy("q").agg(F.min(F.when(F.col("ql") == F.col("label"), F.col("rank"))).alias("rank"))
    m = E.rank_metrics(r.withColumn("slice", F.col("q") % 3), ["slice"])
    return m.select("slice", "n", *(F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "hit_10", "mrr")))


_SC = "sc AS (SELECT lang, toxic AS y, round(n_chars % 97 / 97.0 + toxic * 0.3, 3) AS s FROM labels JOIN documents USING (doc_id))"


def scores(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return j.select("lang", F.col("toxic").alias("y"), F.round(F.col("n_chars") % 97 / 97.0 + F.col("toxic") * 0.3, 3).alias("s"))


@operator(f"WITH {_SC} SELECT lang, CAST(count(*) FILTER (y = 1) AS BIGINT) AS p, CAST(count(*) FILTER (y = 0) AS BIGINT) AS q, round((SELECT avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) FROM sc a JOIN sc b ON a.y = 1 AND b.y = 0 AND a.lang = sc.lang AND b.lang = sc.lang), 6) AS auc FROM sc GROUP BY lang HAVING count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0")
def auc_ranks(spark, sf):
    """AUC from ranks instead of pairs."""
    return E.auc(scores(spark, sf), "s", "y", ["lang"]).select("lang", "p", "q", F.round("auc", 6).alias("auc"))


@operator(f"WITH {_SC}, n AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM sc) SELECT t.s AS threshold, round((SELECT count(*) FROM sc WHERE y = 1 AND s >= t.s) / p - (SELECT count(*) FROM sc WHERE y = 0 AND s >= t.s) / q, 6) AS youden FROM (SELECT DISTINCT s FROM sc) t, n ORDER BY 2 DESC, 1 LIMIT 1")
def best_threshold(spark, sf):
    """The threshold of the largest Youden index."""
    return E.best_threshold(scores(spark, sf), "s", "y").select("threshold", F.round("youden", 6).alias("youden"))


@operator(f"WITH {_DT}, pool AS (SELECT doc_id, source FROM documents), n AS (SELECT source, count(*) AS n FROM pool GROUP BY source), f AS (SELECT source, tok, count(*) AS df FROM dt JOIN pool USING (doc_id) GROUP BY ALL) SELECT source, CAST(count(*) AS BIGINT) AS distinctive FROM f JOIN n USING (source) WHERE df <= greatest(2, 0.3 * n) AND df > 1 GROUP BY source")
def pool_df(spark, sf):
    """Shared terms that few of a pool have."""
    pool = table(spark, sf, "documents").select("doc_id", "source")
    n = pool.groupBy("source").agg(F.count("*").alias("n"))
    f = doc_terms(spark, sf).join(pool, "doc_id").groupBy("source", "tok").agg(F.count("*").alias("df"))
    return f.join(n, "source").where("df <= greatest(2, 0.3 * n) AND df > 1").groupBy("source").agg(F.count("*").alias("distinctive"))


@operator("SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest, CAST(count(*) AS BIGINT) AS n, max(o_orderkey) AS revision FROM orders GROUP BY o_custkey")
def members_digest(spark, sf):
    """Digests that don't depend on order, sizes and latest revisions."""
    ids = F.array_sort(F.collect_set(F.col("o_orderkey").cast("string")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(ids, ","), 256).alias("digest"), F.count("*").alias("n"), F.max("o_orderkey").alias("revision"))


@operator("WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS d FROM events GROUP BY user_id) SELECT CAST(user_id % 5 AS BIGINT) AS g, round(avg(CASE WHEN d = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS accepted, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1")
def acceptance(spark, sf):
    """Only the last decision of each counts."""
    l = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("d"))
    return l.groupBy((F.col("user_id") % 5).alias("g")).agg(F.round(F.avg(F.when(F.col("d") == "purchase", 1.0).otherwise(0.0)), 6).alias("accepted"), F.count("*").alias("n"))


@operator("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'DROP' WHEN count(*) < 2 THEN 'incomplete' WHEN bool_and(l_returnflag = 'N') THEN 'KEEP' WHEN count(DISTINCT l_linestatus) = 1 THEN 'FIX:' || min(l_linestatus) ELSE 'conflict' END AS verdict FROM lineitem GROUP BY l_orderkey""")
def verdict_combine(spark, sf):
    """Verdicts of a group combined."""
    f = F.col("l_returnflag")
    v = F.when(F.bool_or(f == "R"), "DROP").when(F.count("*") < 2, "incomplete").when(F.bool_and(f == "N"), "KEEP").when(F.size(F.collect_set("l_linestatus")) == 1, F.concat(F.lit("FIX:"), F.min("l_linestatus"))).otherwise("conflict")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(v.alias("verdict"))


@operator(r"""WITH x AS (SELECT doc_id, unnest([CASE WHEN length(text) > 10000 THEN 'too-long' END, CASE WHEN text = '' THEN 'empty' END, CASE WHEN regexp_matches(text, '\t') THEN 'tab' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'mail' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'lang' END]) AS rule FROM documents)
SELECT rule, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM x WHERE rule IS NOT NULL GROUP BY rule""")
def lint_counts(spark, sf):
    """Findings by rule."""
    r = F.array(
        F.when(F.length("text") > 10000, "too-long"), F.when(F.col("text") == "", "empty"), F.when(F.col("text").rlike(r"\t"), "tab"), F.when(F.col("text").rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), "mail"), F.when(~F.col("lang").isin("en", "de"), "lang")
    )
    return table(spark, sf, "documents").select("doc_id", F.explode(r).alias("rule")).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@operator("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(1 - list_dot_product(a.e, b.e)) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, la, min(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM p GROUP BY ALL) SELECT la AS label, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY la""")
def silhouette(spark, sf):
    """Mean silhouette by label. With unit vectors the mean distance to a label is 1 minus the dot product with its sum, so no pairs are made."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    s = v.select("label", F.posexplode("e")).groupBy("label", "pos").agg(F.sum("col").alias("c")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("sum"))
    n = v.groupBy("label").agg(F.count("*").alias("k"))
    c = F.broadcast(s.join(n, "label").select(F.col("label").alias("other"), "sum", "k"))  # a row for each label
    dot = F.aggregate(F.zip_with("e", "sum", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    own = F.aggregate(F.transform("e", lambda x: x * x), F.lit(0.0), lambda x, y: x + y)
    same = F.col("label") == F.col("other")
    d = v.crossJoin(c).withColumn("d", F.when(same, F.when(F.col("k") > 1, 1 - (dot - own) / (F.col("k") - 1))).otherwise(1 - dot / F.col("k")))
    x = d.groupBy("vec_id", "label").agg(F.min(F.when(same, F.col("d"))).alias("a"), F.min(F.when(~same, F.col("d"))).alias("b"))
    return x.groupBy("label").agg(F.round(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))), 4).alias("silhouette"), F.count("*").alias("n"))


@operator("SELECT strftime(m, '%Y-%m') AS bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY o_custkey) GROUP BY 1")
def month_buckets(spark, sf):
    """Groups by the month of their newest date."""
    m = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
    return m.groupBy(F.date_format("m", "yyyy-MM").alias("bucket")).agg(F.count("*").alias("n"))


@operator("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_levels(spark, sf):
    """2.X: CUBE."""
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
