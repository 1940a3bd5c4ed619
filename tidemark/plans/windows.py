"""Windows, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ranks import running
from tidemark.operators.retrieval import top_k
from tidemark.plans.aggregates import doc_terms
from tidemark.plans.registry import operator
from tidemark.session import cut
from tidemark.sources.tables import table


@operator("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def distinct_on_latest(spark, sf):
    """The first row of each key by an order."""
    return top_k(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 1).select("user_id", "event_id", "event_type")


@operator("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, count(*) OVER () AS total, lag(o_orderkey) OVER w AS before_key, lead(o_orderkey) OVER w AS after_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_ranks(spark, sf):
    """Positions in lists, a total beside the rows, neighbours."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders")
    n = o.agg(F.count("*").alias("total"))
    r = lambda f, c: f().over(w).cast("long").alias(c)
    return o.crossJoin(F.broadcast(n)).select("o_custkey", "o_orderkey", r(F.row_number, "rn"), r(F.rank, "rk"), r(F.dense_rank, "dr"), "total", F.lag("o_orderkey").over(w).alias("before_key"), F.lead("o_orderkey").over(w).alias("after_key"))


@operator("WITH b AS (SELECT user_id, event_type, min(rk) AS r FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rk FROM events) GROUP BY ALL) SELECT user_id, round(sum(1.0 / (60 + r)), 8) AS score FROM b GROUP BY user_id")
def item_votes(spark, sf):
    """An item's best rank in each list votes once."""
    e = running(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["event_type"], [F.col("value").desc(), F.col("event_id")])
    return e.groupBy("user_id", "event_type").agg(F.min("row_no").alias("r")).groupBy("user_id").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 8).alias("score"))


@operator("""WITH p AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS pos FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS j FROM p)
SELECT x.user_id, x.pos, y.event_id FROM a x JOIN a y ON x.user_id = y.user_id AND x.event_type = y.event_type AND x.k = y.j""")
def ties_newer_first(spark, sf):
    """Inside a run of equals the newer come first, and the run keeps its places."""
    p = table(spark, sf, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_type", "event_id")).cast("long"))
    run = Window.partitionBy("user_id", "event_type")
    a = p.withColumns({"k": F.row_number().over(run.orderBy("pos")), "j": F.row_number().over(run.orderBy(F.col("ts").desc(), "event_id"))})
    y = a.select("user_id", "event_type", F.col("j").alias("k"), F.col("event_id").alias("e"))
    return a.select("user_id", "event_type", "k", "pos").join(y, ["user_id", "event_type", "k"]).select("user_id", "pos", F.col("e").alias("event_id"))


@operator("SELECT o_orderpriority, o_orderdate, CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM (SELECT o_orderpriority, o_orderdate, count(*) AS n FROM orders GROUP BY ALL)")
def running_df(spark, sf):
    """Running totals over pre-aggregated counts."""
    n = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.select("o_orderpriority", "o_orderdate", F.sum("n").over(w).alias("so_far"))


@operator("SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars % 10, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000")
def budget_pack(spark, sf):
    """Packing a prefix under a budget; a source's rows are sorted up to the range in which the budget ends."""
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return running(d, ["source"], [F.col("n_chars") % 10, F.col("doc_id")], F.col("n_chars"), 20000).select("source", "doc_id", "used")


@operator("WITH l AS (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CAST(grp AS BIGINT) AS grp, role = 'assistant' AND coalesce(next_role, 'user') = 'user' AS final FROM l")
def turn_groups(spark, sf):
    """Answers between user turns, the last of each marked."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations")
    grp = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return c.select("conv_id", "turn", grp.alias("grp"), ((F.col("role") == "assistant") & (F.coalesce(F.lead("role").over(w), F.lit("user")) == "user")).alias("final"))


@operator(r"WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)) SELECT doc_id, i - 1 AS line_no FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l) WHERE regexp_matches(line, '[.]$') AND regexp_matches(nxt, '^[A-D]')")
def adjacent_pair(spark, sf):
    """A test on two adjacent lines."""
    l = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return l.withColumn("nxt", F.lead("line").over(w)).where(F.col("line").rlike("[.]$") & F.col("nxt").rlike("^[A-D]")).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@operator("SELECT source, doc_id, CAST(rn AS BIGINT) AS rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn <= 10")
def newest_k(spark, sf):
    """The newest ten of each source."""
    return top_k(table(spark, sf, "documents"), ["source"], [F.col("doc_id").desc()], 10).select("source", "doc_id", F.col("rank").cast("long").alias("rn"))


@operator("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_orderkey, l_linenumber) = 1 AS clean FROM lineitem")
def first_clean_wins(spark, sf):
    """Later rows of a pair are errors."""
    w = Window.partitionBy(F.least("l_partkey", "l_suppkey"), F.greatest("l_partkey", "l_suppkey")).orderBy("l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) == 1).alias("clean"))


@operator("SELECT lang, doc_id, CAST(ntile(7) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS slice FROM documents")
def ntile_slices(spark, sf):
    """Near-equal contiguous slices."""
    d = running(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], [F.col("doc_id")])
    least, longer = F.floor(F.col("total") / 7), F.col("total") % 7
    head = longer * (least + 1)  # rows in the slices that are one longer
    tail = longer + F.ceil((F.col("row_no") - head) / F.greatest(least, F.lit(1)))
    return d.select("lang", "doc_id", F.when(F.col("row_no") <= head, F.ceil(F.col("row_no") / (least + 1))).otherwise(tail).cast("long").alias("slice"))


@operator("WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, length(bin(count(*) OVER (PARTITION BY source))) AS width FROM documents) SELECT source, doc_id, CAST((SELECT sum(((i >> b) & 1) << (width - 1 - b)) FROM unnest(range(0, width)) AS u(b)) AS BIGINT) AS spread FROM p")
def spread_order(spark, sf):
    """Bit-reversed positions, as wide as the source's count needs; any prefix of their order covers the list."""
    d = running(table(spark, sf, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")])
    d = d.withColumns({"i": F.col("row_no") - 1, "width": F.length(F.bin("total"))})
    return d.select("source", "doc_id", F.conv(F.reverse(F.expr("lpad(bin(i), width, '0')")), 2, 10).cast("long").alias("spread"))


@operator("WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) SELECT lang, doc_id, CAST(k AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rn, source, doc_id) AS k FROM r) WHERE k <= 30")
def stratified_sample(spark, sf):
    """A quota for each stratum, sub-groups in turn."""
    # no sub-group gives more than the quota, and a limit by rank is applied before rows are shuffled
    r = table(spark, sf, "documents").select("lang", "source", "doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    r = top_k(r, ["lang", "source"], [F.col("h"), F.col("doc_id")], 30).withColumnRenamed("rank", "rn")
    return top_k(r, ["lang"], [F.col("rn"), F.col("source"), F.col("doc_id")], 30).select("lang", "doc_id", F.col("rank").cast("long").alias("k"))


#: Rows of a range of collapse_neighbours, on average.
RANGE_ROWS = 100_000


def _ranged(d, by):
    """``d`` in ranges of the order ``by``, numbered by ``run``, so that a user's many rows are no one task's."""
    return cut(d.repartitionByRange(max(1, d.count() // RANGE_ROWS), *by).withColumn("run", F.spark_partition_id()))


def _carried(d, parts):
    """``d`` with the columns of ``parts`` of the same user and run."""
    p = parts.withColumnsRenamed({"user_id": "u", "run": "r"})
    return d.join(p, d["user_id"].eqNullSafe(p["u"]) & (d["run"] == p["r"])).drop("u", "r")


def collapse(events):
    """(user_id, pos, event_id): in order of value, the greatest first, an event is dropped if one of its user within ±1 of its id was kept.

    An event hangs on neighbours before it in that order, these on theirs, and so on to an event that has none, which is kept; along such a chain
    kept and dropped events take turns. So an event is kept if its distance to the end of each of its two chains is even.
    """
    place = F.struct((-F.col("value")).alias("v"), F.col("event_id").alias("id"))
    e = events.select("user_id", F.col("event_id").alias("id"), place.alias("o"))
    own = lambda shift, at: F.struct((F.col("id") + shift).alias("id"), *(F.when(F.lit(k == at), F.col("o")).alias(k) for k in ("o", "lo", "hi")))
    x = e.where("id IS NOT NULL").select("user_id", F.inline(F.array(own(0, "o"), own(1, "lo"), own(-1, "hi"))))
    x = x.groupBy("user_id", "id").agg(*(F.min(k).alias(k) for k in ("o", "lo", "hi"))).where("o IS NOT NULL")
    first = lambda k: F.coalesce(F.col(k) < F.col("o"), F.lit(False))
    x = x.select("user_id", "id", "o", F.when(~first("lo"), F.col("id")).alias("a"), F.when(~first("hi"), F.col("id")).alias("b"))
    x = _ranged(x, ["user_id", "id"])
    user = Window.partitionBy("user_id").orderBy("run")
    ends = x.groupBy("user_id", "run").agg(F.max("a").alias("a"), F.min("b").alias("b"))  # a row for each user and range
    ends = ends.select("user_id", "run", F.max("a").over(user.rowsBetween(Window.unboundedPreceding, -1)).alias("a_before"), F.min("b").over(user.rowsBetween(1, Window.unboundedFollowing)).alias("b_after"))
    run = Window.partitionBy("user_id", "run").orderBy("id")
    back = Window.partitionBy("user_id", "run").orderBy(F.col("id").desc())
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = _carried(x.withColumns({"a": F.max("a").over(upto(run)), "b": F.min("b").over(upto(back))}), ends)
    even = lambda d: F.pmod(d, F.lit(2)) == 0
    kept = x.where(even(F.col("id") - F.coalesce("a", "a_before")) & even(F.coalesce("b", "b_after") - F.col("id"))).select("user_id", "o.v", "id")
    kept = _ranged(kept.unionAll(e.where("id IS NULL").select("user_id", "o.v", "id")), ["user_id", "v", "id"])
    starts = kept.groupBy("user_id", "run").agg(F.count("*").alias("n"))
    starts = starts.select("user_id", "run", F.coalesce(F.sum("n").over(user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    kept = kept.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "run").orderBy("v", "id")))
    return _carried(kept, starts).select("user_id", (F.col("start") + F.col("rn") - 1).cast("int").alias("pos"), F.col("id").alias("event_id"))


@operator()
def collapse_neighbours(spark, sf):
    """In order of value, an event is dropped if one within ±1 of its id was kept."""
    return collapse(table(spark, sf, "events"))


@operator("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def topk_lexical(spark, sf):
    """a top-k report by a total order."""
    return table(spark, sf, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20).select("p_partkey", "p_retailprice")


@operator("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 50")
def queue_order(spark, sf):
    """The head of a queue by priority, due time and id."""
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@operator("SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 0 THEN s_acctbal END DESC NULLS LAST, s_suppkey) AS BIGINT) AS rn FROM supplier")
def nulls_last(spark, sf):
    """F8: descending, nulls last."""
    s = table(spark, sf, "supplier").withColumn("b", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    return s.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("b").desc_nulls_last(), "s_suppkey")).cast("long").alias("rn"))


@operator("WITH m AS (SELECT conv_id, turn, length(text) AS n, turn = 0 OR turn = max(turn) OVER (PARTITION BY conv_id) AS must FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY must DESC, n, turn ROWS UNBOUNDED PRECEDING) AS used FROM m) WHERE must OR used <= 800")
def mandatory_pack(spark, sf):
    """first and last turns stay, then the shortest under a cap."""
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"), ((F.col("turn") == 0) | (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id")))).alias("must"))
    w = Window.partitionBy("conv_id").orderBy(F.col("must").desc(), "n", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.withColumn("used", F.sum("n").over(w)).where("must OR used <= 800").select("conv_id", "turn", "used")


@operator("SELECT u, live, shadow, CASE WHEN live AND shadow THEN 'both' WHEN live THEN 'live' ELSE 'shadow' END AS side FROM (SELECT user_id AS u, bool_or(event_type = 'view') AS live, bool_or(event_type = 'click') AS shadow FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id)")
def set_diff_runs(spark, sf):
    """Both sides, one side only, by a full outer join of distinct keys."""
    e = table(spark, sf, "events")
    one = lambda t, c: e.where(F.col("event_type") == t).select(F.col("user_id").alias("u"), F.lit(True).alias(c)).distinct()
    j = one("view", "live").join(one("click", "shadow"), "u", "full_outer").select("u", F.coalesce("live", F.lit(False)).alias("live"), F.coalesce("shadow", F.lit(False)).alias("shadow"))
    return j.withColumn("side", F.when(F.col("live") & F.col("shadow"), "both").when(F.col("live"), "live").otherwise("shadow"))


@operator("(SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL (SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')")
def set_operations(spark, sf):
    """EXCEPT, INTERSECT, UNION ALL."""
    e = table(spark, sf, "events")
    of = lambda t: e.where(F.col("event_type") == t).select("user_id")
    return of("view").subtract(of("purchase")).unionByName(of("signup").intersect(of("error")))


@operator("WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents) SELECT digest, doc_id, min(doc_id) OVER (PARTITION BY digest) AS kept, CAST(count(*) OVER (PARTITION BY digest) AS BIGINT) AS n FROM d QUALIFY count(*) OVER (PARTITION BY digest) > 1")
def exact_dup_groups(spark, sf):
    """Members of groups of equal bodies, a row for each, since a group may be of any size; the first is kept."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    g = d.groupBy("digest").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return d.join(g, "digest").select("digest", "doc_id", "kept", "n")


@operator(r"WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark), d AS (SELECT item_id, x, min(i) AS i FROM t, unnest(w) WITH ORDINALITY AS u(x, i) GROUP BY ALL) SELECT item_id, string_agg(x, ' ' ORDER BY i) AS terms FROM (SELECT * FROM d WHERE length(x) >= 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i) <= 24) GROUP BY item_id")
def ordered_dedupe(spark, sf):
    """G5, H1.3: first occurrences in order, at most 24."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.length(x) >= 2)
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.array_distinct(w), 1, 24), " ").alias("terms"))


@operator(r"WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark) SELECT a.item_id AS a_id, b.item_id AS b_id, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) >= 5")
def token_jaccard(spark, sf):
    """G6, H1.18: token-set Jaccard by shared tokens."""
    t = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    x = t.select("item_id", F.size("w").alias("n"), F.explode("w").alias("tok"))
    y = x.select(F.col("item_id").alias("b_id"), F.col("n").alias("m"), "tok")
    j = x.join(y, "tok").where("item_id < b_id").groupBy(F.col("item_id").alias("a_id"), "b_id", "n", "m").agg(F.count("*").alias("k")).where("k >= 5")
    return j.select("a_id", "b_id", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("jaccard"))


@operator()
def approximate(spark, sf):
    """2.X, D7: sketches in place of exact counts."""
    return doc_terms(spark, sf).groupBy(F.substring("tok", 1, 1).alias("letter")).agg(F.approx_count_distinct("tok", 0.02).alias("tokens"), F.hll_sketch_estimate(F.hll_sketch_agg("tok")).alias("hll"))
