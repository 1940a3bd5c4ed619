"""Scans, predicates, temporal row sets and joins over the derived versions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import predicates as P
from tidemark.operators import temporal as T
from tidemark.plans.registry import operator
from tidemark.sources.model import VERSIONS, versions
from tidemark.sources.tables import table

V_AT, K_AT = "1996-06-01", "1996-06-05"
LIVE = f"valid_from <= TIMESTAMP '{V_AT}' AND (valid_to IS NULL OR TIMESTAMP '{V_AT}' < valid_to) AND recorded_at <= TIMESTAMP '{K_AT}' AND (superseded_at IS NULL OR TIMESTAMP '{K_AT}' < superseded_at)"
SCOPES = ["all", "class:work", "device:3"]
IN_SCOPES = "('all', 'class:work', 'device:3')"


@operator(f"WITH {VERSIONS} SELECT version_id, logical_id, valid_from, valid_to, kind, status FROM versions WHERE list_contains(project_ids, 7) AND device_scope IN {IN_SCOPES} AND {LIVE} AND status IN ('O', 'F')")
def asof_versions(spark, sf):
    """What a device may see of a project, valid at one instant as known at another."""
    return versions(spark, sf).where(P.hit_filter(7, SCOPES, V_AT, K_AT, ["O", "F"])).select("version_id", "logical_id", "valid_from", "valid_to", "kind", "status")


@operator(f"WITH {VERSIONS} SELECT logical_id, version_id, valid_from, kind, CAST((SELECT count(*) FROM lineitem l WHERE l.l_orderkey = version_id) AS BIGINT) AS n_parts FROM versions WHERE superseded_at IS NULL AND valid_to IS NULL AND status <> 'P'")
def current_heads(spark, sf):
    """A3: open heads with a correlated count as a left join on a grouped count."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("version_id")).agg(F.count("*").alias("n"))
    h = versions(spark, sf).where("superseded_at IS NULL AND valid_to IS NULL AND status <> 'P'")
    return h.join(n, "version_id", "left").select("logical_id", "version_id", "valid_from", "kind", F.coalesce("n", F.lit(0)).alias("n_parts"))


@operator(f"WITH {VERSIONS} SELECT version_id, logical_id, valid_from, valid_to, row_number() OVER (PARTITION BY logical_id ORDER BY version_id) AS seq FROM versions WHERE superseded_at IS NULL")
def version_history(spark, sf):
    """A4: all open segments of some items in order of version."""
    w = Window.partitionBy("logical_id").orderBy("version_id")
    v = versions(spark, sf).where("superseded_at IS NULL")
    return v.select("version_id", "logical_id", "valid_from", "valid_to", F.row_number().over(w).cast("long").alias("seq"))


@operator(f"WITH {VERSIONS} SELECT version_id, logical_id, status FROM versions WHERE version_id IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 50) AND list_contains(project_ids, 7)")
def bulk_lookup(spark, sf):
    """Rows of a list of ids under authorisation."""
    ids = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("version_id")).distinct()
    return versions(spark, sf).where(F.array_contains("project_ids", 7)).join(ids, "version_id", "left_semi").select("version_id", "logical_id", "status")


@operator(f"WITH {VERSIONS} SELECT device_scope, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT logical_id) AS BIGINT) AS items FROM versions WHERE list_contains(project_ids, 27) AND device_scope IN ('all', 'class:work', 'device:5') GROUP BY device_scope")
def authz_visible(spark, sf):
    """Scope expansion of a device, then what it sees by scope."""
    v = versions(spark, sf).where(P.authz(27, P.scopes_of(5, "work")))
    return v.groupBy("device_scope").agg(F.count("*").alias("n"), F.countDistinct("logical_id").alias("items"))


@operator("SELECT s_nationkey AS project_id, CAST(count(*) AS BIGINT) AS grants, max(CASE s_suppkey % 3 WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS role FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 AND n_regionkey <> 2 GROUP BY s_nationkey")
def readable_projects(spark, sf):
    """Projects with a live grant, outside an excluded region; the highest role of each."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation").where("n_regionkey <> 2")
    role = F.when(F.col("s_suppkey") % 3 == 2, 2).when(F.col("s_suppkey") % 3 == 1, 1).otherwise(0)
    return s.where("s_acctbal > 0").join(n, s.s_nationkey == n.n_nationkey, "left_semi").groupBy(F.col("s_nationkey").alias("project_id")).agg(F.count("*").alias("grants"), F.max(role).alias("role"))


@operator(f"""WITH {VERSIONS}, g AS (SELECT v.version_id, CASE WHEN n_regionkey = 2 THEN 'own:' || n_nationkey ELSE 'account:' || n_regionkey END AS k FROM versions v, unnest(v.project_ids) AS u(p) JOIN nation ON n_nationkey = p % 25)
SELECT version_id, CAST(count(DISTINCT k) AS BIGINT) AS n_groups, count(DISTINCT k) <= 1 AS allowed FROM g GROUP BY version_id""")
def isolation_groups(spark, sf):
    """The isolation group of every project of a version; relations are allowed inside one group only."""
    n = table(spark, sf, "nation")
    key = F.when(F.col("n_regionkey") == 2, F.concat(F.lit("own:"), F.col("n_nationkey").cast("string"))).otherwise(F.concat(F.lit("account:"), F.col("n_regionkey").cast("string")))
    g = versions(spark, sf).select("version_id", F.explode(F.transform("project_ids", lambda p: p % 25)).alias("p")).join(F.broadcast(n.select(F.col("n_nationkey").alias("p"), key.alias("k"))), "p")
    return g.groupBy("version_id").agg(F.countDistinct("k").alias("n_groups")).withColumn("allowed", F.col("n_groups") <= 1)


@operator(f"WITH {VERSIONS} SELECT version_id, list_has_any(project_ids, [3, 26]) AS shares, list_has_all([0, 1, 2, 3, 4, 25, 26, 27, 28, 29], project_ids) AS inside FROM versions")
def array_overlap(spark, sf):
    """Overlap and containment of project arrays."""
    few, all_ = F.array(F.lit(3), F.lit(26)), F.array(*(F.lit(i) for i in (0, 1, 2, 3, 4, 25, 26, 27, 28, 29)))
    return versions(spark, sf).select("version_id", F.arrays_overlap("project_ids", few).alias("shares"), (F.size(F.array_except("project_ids", all_)) == 0).alias("inside"))


@operator(f"""WITH {VERSIONS} SELECT a.version_id AS a_id, b.version_id AS b_id FROM versions a JOIN versions b ON a.logical_id = b.logical_id AND a.version_id < b.version_id
WHERE (b.superseded_at IS NULL OR a.recorded_at < b.superseded_at) AND (a.superseded_at IS NULL OR b.recorded_at < a.superseded_at)""")
def interval_overlap_pairs(spark, sf):
    """An equi-join on the item with half-open overlap as residual."""
    v = versions(spark, sf).select("logical_id", "version_id", "recorded_at", "superseded_at")
    a, b = v.alias("a"), v.alias("b")
    o = P.overlaps((F.col("a.recorded_at"), F.col("a.superseded_at")), (F.col("b.recorded_at"), F.col("b.superseded_at")))
    return a.join(b, (F.col("a.logical_id") == F.col("b.logical_id")) & (F.col("a.version_id") < F.col("b.version_id")) & o).select(F.col("a.version_id").alias("a_id"), F.col("b.version_id").alias("b_id"))


_C = ("1995-03-01", "1996-09-01")


@operator(f"""WITH {VERSIONS} SELECT version_id, valid_from, CASE WHEN valid_to IS NULL OR valid_to > TIMESTAMP '{_C[0]}' THEN TIMESTAMP '{_C[0]}' ELSE valid_to END AS valid_to FROM versions WHERE valid_from < TIMESTAMP '{_C[0]}'
UNION ALL SELECT version_id, greatest(valid_from, TIMESTAMP '{_C[1]}'), valid_to FROM versions WHERE valid_to IS NULL OR valid_to > TIMESTAMP '{_C[1]}'""")
def survivors(spark, sf):
    """H3.4: segments left outside a correction."""
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return T.survivors(versions(spark, sf).select("version_id", "valid_from", "valid_to"), ts(_C[0]), ts(_C[1]))


_FIX = "SELECT logical_id, TIMESTAMP '1995-03-01' AS fix_from, TIMESTAMP '1996-09-01' AS fix_to, 'FIX' AS fix_kind FROM (SELECT DISTINCT logical_id FROM versions)"
_AT = "1999-01-01"


@operator(f"""WITH {VERSIONS}, fix AS ({_FIX}), t AS (SELECT v.*, fix_from, fix_to, fix_kind FROM versions v JOIN fix USING (logical_id) WHERE superseded_at IS NULL AND valid_from < fix_to AND (valid_to IS NULL OR fix_from < valid_to)),
r AS (SELECT version_id, logical_id, valid_from, valid_to, kind, recorded_at, superseded_at, 'kept' AS op FROM versions WHERE version_id NOT IN (SELECT version_id FROM t)
UNION ALL SELECT version_id, logical_id, valid_from, valid_to, kind, recorded_at, TIMESTAMP '{_AT}', 'closed' FROM t
UNION ALL SELECT version_id, logical_id, valid_from, fix_from, kind, TIMESTAMP '{_AT}', superseded_at, 'survivor' FROM t WHERE valid_from < fix_from
UNION ALL SELECT version_id, logical_id, greatest(valid_from, fix_to), valid_to, kind, TIMESTAMP '{_AT}', superseded_at, 'survivor' FROM t WHERE valid_to IS NULL OR valid_to > fix_to
UNION ALL SELECT max(version_id), logical_id, fix_from, fix_to, 'FIX', TIMESTAMP '{_AT}', NULL, 'replacement' FROM t GROUP BY logical_id, fix_from, fix_to)
SELECT * FROM r""")
def correction_rowset(spark, sf):
    """K1-K4: the whole new row set after corrections."""
    v = versions(spark, sf)
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    fixes = v.select("logical_id").distinct().withColumns({"fix_from": ts("1995-03-01"), "fix_to": ts("1996-09-01"), "fix_kind": F.lit("FIX")})
    return T.correct(v, fixes, ts(_AT))


@operator(f"WITH {VERSIONS} SELECT version_id, logical_id, valid_from, TIMESTAMP '1998-02-01' AS valid_to, status FROM versions WHERE superseded_at IS NULL AND valid_from < TIMESTAMP '1998-02-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-02-01')")
def close_rowset(spark, sf):
    """K2: rows whose validity a close ends."""
    at = F.lit("1998-02-01").cast("timestamp_ntz")
    v = versions(spark, sf).where("superseded_at IS NULL").where(P.since_until(F.col("valid_from"), F.col("valid_to"), at) & (F.col("valid_from") < at))
    return v.select("version_id", "logical_id", "valid_from", at.alias("valid_to"), "status")


@operator(f"""WITH {VERSIONS}, bad AS (SELECT * REPLACE (valid_to + to_days(CAST(importance AS INTEGER)) AS valid_to, CASE WHEN importance < 3 THEN NULL ELSE superseded_at END AS superseded_at) FROM versions)
SELECT a.logical_id, a.version_id AS first_id, b.version_id AS second_id FROM bad a JOIN bad b ON a.logical_id = b.logical_id AND a.version_id < b.version_id
WHERE (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to) AND (b.superseded_at IS NULL OR a.recorded_at < b.superseded_at) AND (a.superseded_at IS NULL OR b.recorded_at < a.superseded_at)""")
def constraint_violations(spark, sf):
    """K8: rows of an item that overlap in both times, found among rows whose ends were moved."""
    v = versions(spark, sf)
    moved = F.expr("valid_to + make_dt_interval(int(importance))")
    return T.overlap_violations(v.withColumns({"valid_to": moved, "superseded_at": F.when(F.col("importance") >= 3, F.col("superseded_at"))}))


@operator(f"""WITH {VERSIONS} SELECT l_orderkey, l_linenumber, version_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN versions ON logical_id = o_custkey AND valid_from <= l_shipdate AND (valid_to IS NULL OR l_shipdate < valid_to) WHERE l_linenumber = 1""")
def lateral_valid_at_start(spark, sf):
    """The segment valid when a line ships."""
    li = table(spark, sf, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("logical_id"))
    return T.as_of(li.join(o, "l_orderkey"), versions(spark, sf).select("logical_id", "version_id", "valid_from", "valid_to"), "logical_id", "l_shipdate").select("l_orderkey", "l_linenumber", "version_id")


@operator("""SELECT e.event_id, p.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_join(spark, sf):
    """The newest view at or before each purchase of a user, carried forward in one pass over the union."""
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("seen")).agg(F.max("event_id").alias("before_id"))
    return T.newest_before(left, right, "user_id", "event_id", "ts", "seen").select("event_id", "before_id")


@operator("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_exists(spark, sf):
    """EXISTS as a left-semi join."""
    o = table(spark, sf, "orders").where("o_totalprice > 200000")
    c = table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@operator("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_not_exists(spark, sf):
    """NOT EXISTS as a left-anti join."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


@operator("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) ELSE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45) END AS ok FROM part""")
def conditional_exists(spark, sf):
    """One of two existence tests by a flag; both as one grouped left join."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_quantity") > 48).alias("a"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("b"))
    return table(spark, sf, "part").join(li, "p_partkey", "left").select("p_partkey", F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("a")).otherwise(F.col("b")), F.lit(False)).alias("ok"))


@operator("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS total, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS open_n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_outer_counts(spark, sf):
    """A left join with filtered counts."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open_n"))


@operator("WITH p AS (SELECT o_orderkey, unnest([o_custkey, o_orderkey % 100]) AS k, unnest([1, 2]) AS pos FROM orders) SELECT o_orderkey, pos, c_name FROM p JOIN customer ON c_custkey = k")
def unnest_pairs(spark, sf):
    """C11: parallel arrays as a join table."""
    o = table(spark, sf, "orders")
    p = o.select("o_orderkey", F.explode(F.arrays_zip(F.array("o_custkey", F.col("o_orderkey") % 100).alias("k"), F.array(F.lit(1), F.lit(2)).alias("pos"))).alias("x")).select("o_orderkey", "x.k", "x.pos")
    return p.join(table(spark, sf, "customer"), F.col("k") == F.col("c_custkey")).select("o_orderkey", "pos", "c_name")


@operator("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2)")
def multi_in(spark, sf):
    """Rows of duplicate groups by a two-column semi-join."""
    li = table(spark, sf, "lineitem")
    d = li.groupBy("l_partkey", "l_suppkey").count().where("count > 2")
    return li.join(d, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@operator("SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT avg(c_acctbal) AS m FROM customer) WHERE c_acctbal > m GROUP BY n_name, r_name")
def three_way_and_one_row(spark, sf):
    """Equi-joins and a one-row cross join (an aggregate has one row)."""
    c = table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    m = c.agg(F.avg("c_acctbal").alias("m"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).crossJoin(F.broadcast(m)).where("c_acctbal > m")
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@operator("SELECT a.l_orderkey, a.l_linenumber, a.l_quantity - b.l_quantity AS gain FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1 WHERE a.l_returnflag <> b.l_returnflag")
def paired_runs(spark, sf):
    """C20, C14: rows paired with the row before them by key."""
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    b = a.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("l_returnflag <> f").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - F.col("q")).alias("gain"))


@operator("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey AND l_linenumber <= 2")
def unordered_pairs(spark, sf):
    """Pairs in either order are one."""
    li = table(spark, sf, "lineitem").where("l_partkey <> l_suppkey AND l_linenumber <= 2")
    return li.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@operator("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AND event_type IN ('click', 'error')")
def json_filter(spark, sf):
    """B19, H3.11: JSON path predicates."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").where((k >= 50) & F.col("event_type").isin("click", "error")).select("event_id", "event_type", k.alias("k"))


@operator("SELECT event_id, CAST(i AS INTEGER) AS i, k + i AS part FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), unnest([0, 1, 2]) AS u(i) WHERE k > i")
def json_explode(spark, sf):
    """C17, M8: elements of a JSON value, with ordinality."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))
    return e.select("event_id", "k", F.posexplode(F.sequence(F.col("k"), F.col("k") + 2)).alias("i", "part")).where("k > i").select("event_id", "i", "part")


@operator(f"WITH {VERSIONS} SELECT logical_id, version_id FROM versions WHERE (logical_id, version_id) > (100, 0) AND status = 'F' ORDER BY logical_id, version_id LIMIT 51")
def keyset_page(spark, sf):
    """The page after a cursor, and one row more to see whether another follows."""
    cursor = F.struct(F.lit(100).cast("long"), F.lit(0).cast("long"))
    v = versions(spark, sf).where((F.struct("logical_id", "version_id") > cursor) & (F.col("status") == "F"))
    return v.orderBy("logical_id", "version_id").limit(51).select("logical_id", "version_id")


@operator(f"""WITH {VERSIONS} SELECT version_id, CASE WHEN device_scope LIKE 'device:%' THEN 'device-scoped' WHEN list_contains(project_ids, 28) THEN 'policy-off' WHEN status = 'P' THEN 'not-current' WHEN superseded_at IS NOT NULL THEN 'superseded' END AS reason,
superseded_at IS NOT NULL AND superseded_at <= TIMESTAMP '{K_AT}' OR valid_to IS NOT NULL AND valid_to <= TIMESTAMP '{V_AT}' AS stale, coalesce(superseded_at > TIMESTAMP '{K_AT}', false) OR coalesce(valid_to > TIMESTAMP '{K_AT}', false) AS changed_since FROM versions""")
def privacy_gate(spark, sf):
    """The first reason to hold an item back, staleness, and whether it changed after a snapshot."""
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    reason = P.first_reason((F.col("device_scope").startswith("device:"), "device-scoped"), (F.array_contains("project_ids", 28), "policy-off"), (F.col("status") == "P", "not-current"), (F.col("superseded_at").isNotNull(), "superseded"))
    before = lambda c, t: F.coalesce(F.col(c) <= ts(t), F.lit(False))
    after = lambda c: F.coalesce(F.col(c) > ts(K_AT), F.lit(False))
    return versions(spark, sf).select("version_id", reason.alias("reason"), (before("superseded_at", K_AT) | before("valid_to", V_AT)).alias("stale"), (after("superseded_at") | after("valid_to")).alias("changed_since"))


@operator(r"SELECT page_id, regexp_matches(url, '^http://[^/]*/[^/]*/[^/]*$') AS shallow, regexp_matches(url, '^.*\.html$') AS is_html, split_part(url, '/', 3) AS host FROM pages")
def path_scope(spark, sf):
    """B17, H1.30: glob tests of a path, and its first part."""
    p = table(spark, sf, "pages")
    return p.select("page_id", (P.glob(F.col("url"), ["http://*/*/*"])).alias("shallow"), P.glob(F.col("url"), ["**.html"]).alias("is_html"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))


@operator("""WITH d AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(range(0, greatest(1, CAST(ceil(n_chars / 2000.0) AS BIGINT)))) FROM documents) GROUP BY doc_id),
v AS (SELECT vec_id, count(*) AS n FROM embeddings GROUP BY vec_id)
SELECT d.doc_id, CASE WHEN coalesce(v.n, 0) >= d.n THEN 'ready' WHEN d.doc_id % 3 = 0 THEN 'pending' ELSE 'missing' END AS state FROM d LEFT JOIN v ON v.vec_id = d.doc_id""")
def embedding_state(spark, sf):
    """Ready if there are as many vectors as chunks, else pending where a job is in flight."""
    d = table(spark, sf, "documents").groupBy("doc_id").agg(F.max(F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 2000.0))).alias("n"))
    v = table(spark, sf, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.count("*").alias("have"))
    state = F.when(F.coalesce("have", F.lit(0)) >= F.col("n"), "ready").when(F.col("doc_id") % 3 == 0, "pending").otherwise("missing")
    return d.join(v, "doc_id", "left").select("doc_id", state.alias("state"))
