"""Instants, durations, JSON, ids, rounding and predicates by row, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import predicates as P
from tidemark.plans.registry import operator
from tidemark.sources.model import VERSIONS, versions
from tidemark.sources.tables import table


def _at(s):
    return F.lit(s).cast("timestamp_ntz")


@operator("""
SELECT version_id, instant, instant > TIMESTAMP '1998-06-01 00:05:00' AS future, coalesce(valid_to > valid_from, true) AS ordered,
  greatest(TIMESTAMP '1998-06-01', last + INTERVAL 1 MICROSECOND) AS t
FROM (SELECT o_orderkey AS version_id, o_orderdate AS valid_from, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate - INTERVAL 1 DAY WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS valid_to,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 3 HOUR ELSE o_orderdate END AS instant, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last FROM orders)""")
def evidence_instants(spark, sf):
    """H3.2, H3.3, H3.5: dates read in the author's zone, interval and future checks, the next transaction time of an item."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    day = F.expr("interval 1 day")
    at = F.when(k % 3 == 0, d.cast("date").cast("timestamp_ntz") - F.expr("interval 3 hours")).otherwise(d)
    end = F.when(k % 4 == 0, d - day).when(k % 4 == 1, F.lit(None)).otherwise(d + day)
    last = F.max("o_orderdate").over(Window.partitionBy("o_custkey"))
    o = table(spark, sf, "orders").select(k.alias("version_id"), at.alias("instant"), F.coalesce(end > d, F.lit(True)).alias("ordered"), last.alias("last"))
    t = F.greatest(_at("1998-06-01"), F.col("last") + F.expr("interval 1 microsecond"))
    return o.select("version_id", "instant", (F.col("instant") > _at("1998-06-01 00:05:00")).alias("future"), "ordered", t.alias("t"))


@operator(r"""WITH d AS (SELECT event_id, (event_id % 90) || ['s', 'm', 'h', 'd', 'w', 'y'][event_id % 6 + 1] AS raw FROM events)
SELECT event_id, raw, CASE WHEN regexp_matches(raw, '^[0-9]+[smhdw]$') THEN CAST(regexp_extract(raw, '^([0-9]+)', 1) AS BIGINT) * CASE right(raw, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'w' THEN 604800 END END AS seconds FROM d""")
def duration_parse(spark, sf):
    """H3.7: seconds of 90s, 30m, 2h, 7d and 2w; anything else is null."""
    unit = F.element_at(F.array(*(F.lit(x) for x in "smhdwy")), (F.col("event_id") % 6 + 1).cast("int"))
    d = table(spark, sf, "events").select("event_id", F.concat((F.col("event_id") % 90).cast("string"), unit).alias("raw"))
    factor = F.create_map(*(F.lit(x) for p in {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}.items() for x in p))
    ok = F.col("raw").rlike("^[0-9]+[smhdw]$")
    return d.withColumn("seconds", F.when(ok, F.regexp_extract("raw", "^([0-9]+)", 1).cast("long") * F.get(F.array(factor[F.right("raw", F.lit(1))]), 0)))


@operator("""SELECT event_id, CAST(json_object('k', k, 'type', event_type, 'user', user_id) AS VARCHAR) AS merged, CAST(json_object('k', k, 'type', event_type) AS VARCHAR) AS without_user,
  sha256(CAST(json_object('k', k, 'type', event_type, 'user', user_id) AS VARCHAR)) AS digest FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_merge(spark, sf):
    """H3.11, H3.12: an object merged into a JSON value, a key deleted, canonical text (sorted keys, compact) and its digest."""
    e = table(spark, sf, "events").withColumn("k", F.from_json("props", "k long").k)
    canonical = lambda **c: F.to_json(F.struct(*(x.alias(n) for n, x in sorted(c.items()))))
    merged = canonical(user=F.col("user_id"), type=F.col("event_type"), k=F.col("k"))
    return e.select("event_id", merged.alias("merged"), canonical(type=F.col("event_type"), k=F.col("k")).alias("without_user"), F.sha2(merged, 256).alias("digest"))


#: The published namespace for URLs of name-based identifiers (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
_NS = "".join(f"\\x{URL_NAMESPACE[i : i + 2].upper()}" for i in range(0, 32, 2))


def uuid5(name, namespace: str = URL_NAMESPACE):
    """Name-based identifiers of version 5: bits of a SHA-1 with the version and the variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


@operator(rf"""WITH h AS (SELECT page_id, url, sha1('{_NS}'::BLOB || encode(url)) AS h FROM pages)
SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 'web:' || url END AS source_key,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def name_ids(spark, sf):
    """H3.13, H3.17: name-based ids and source keys; a row without a system has no key."""
    key = F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("web:"), F.col("url")))
    return table(spark, sf, "pages").select("page_id", key.alias("source_key"), uuid5(F.col("url")).alias("id"))


@operator(r"""WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'v' || user_id WHEN 1 THEN 'v' || user_id || '.' || event_id % 9 WHEN 2 THEN 'v0' || user_id ELSE 'x' || user_id END AS clue FROM events)
SELECT event_id, clue, TRY_CAST(nullif(regexp_extract(clue, '^v([1-9][0-9]*)(?:\.(0|[1-9][0-9]*))?$', 1), '') AS BIGINT) AS version, TRY_CAST(nullif(regexp_extract(clue, '^v([1-9][0-9]*)(?:\.(0|[1-9][0-9]*))?$', 2), '') AS BIGINT) AS ordinal FROM c""")
def clue_decode(spark, sf):
    """H3.14: strict parts of a clue; leading zeros and other letters are no clue."""
    u, m = F.col("user_id").cast("string"), F.col("event_id") % 4
    clue = F.when(m == 0, F.concat(F.lit("v"), u)).when(m == 1, F.concat(F.lit("v"), u, F.lit("."), (F.col("event_id") % 9).cast("string"))).when(m == 2, F.concat(F.lit("v0"), u)).otherwise(F.concat(F.lit("x"), u))
    part = lambda i: F.nullif(F.regexp_extract("clue", r"^v([1-9][0-9]*)(?:\.(0|[1-9][0-9]*))?$", i), F.lit("")).try_cast("long")
    return table(spark, sf, "events").select("event_id", clue.alias("clue")).select("event_id", "clue", part(1).alias("version"), part(2).alias("ordinal"))


@operator("SELECT p_partkey, n, CAST(place AS INTEGER) AS place FROM (SELECT p_partkey, range(p_size % 4, p_size % 4 + p_size % 3) AS s FROM part), unnest(s) WITH ORDINALITY AS u(n, place)")
def generate_ordinality(spark, sf):
    """H3.15: generated series taken apart with their places."""
    lo, k = F.col("p_size") % 4, F.col("p_size") % 3
    s = F.when(k > 0, F.sequence(lo, lo + F.greatest(k, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(s).alias("at", "n")).select("p_partkey", F.col("n").cast("long").alias("n"), (F.col("at") + 1).alias("place"))


@operator("SELECT event_type, CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(min(ts))) AS BIGINT) AS oldest_age, max(ts) AS last_done, CAST(count(*) FILTER (value > 50) AS BIGINT) AS waiting FROM events GROUP BY event_type")
def age_metrics(spark, sf):
    """The age of the oldest row, the last one, and how many wait."""
    age = F.unix_timestamp(F.lit("2030-01-01").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy("event_type").agg(age.alias("oldest_age"), F.max("ts").alias("last_done"), F.count_if(F.col("value") > 50).alias("waiting"))


@operator("SELECT c_custkey, split_part(c_name, '#', 1) AS account, split_part(c_name, '#', 2) AS member, regexp_matches(c_name, '[ığşİĞŞ]') AS turkish FROM customer")
def account_naming(spark, sf):
    """H3.21, H1.39: the account part of a name, the member, and a letter test for a language."""
    name = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", F.substring_index(name, "#", 1).alias("account"), F.split_part(name, F.lit("#"), F.lit(2)).alias("member"), name.rlike("[ığşİĞŞ]").alias("turkish"))


@operator("SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_extendedprice * l_discount AS DECIMAL(14, 4)), 2) AS DOUBLE) AS bankers, CAST(round(CAST(l_extendedprice * l_discount AS DECIMAL(14, 4)), 2) AS DOUBLE) AS half_up FROM lineitem")
def rounding(spark, sf):
    """H3.10: half-even and half-up rounding of decimals."""
    x = (F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(14,4)")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.bround(x, 2).cast("double").alias("bankers"), F.round(x, 2).cast("double").alias("half_up"))


@operator(r"SELECT page_id, regexp_matches(url, '(^|[^0-9])1[0-9]?([^0-9]|$)') AS has_key FROM pages")
def key_in_text(spark, sf):
    """H3.19: an answer key as a number of its own, not inside a longer one."""
    return table(spark, sf, "pages").select("page_id", F.col("url").rlike("(^|[^0-9])1[0-9]?([^0-9]|$)").alias("has_key"))


@operator("""SELECT event_id, CASE WHEN status = 402 OR regexp_matches(body, 'quota|billing|credit') THEN 'billing' WHEN status = 429 AND event_id % 2 = 0 THEN 'retry' WHEN status = 429 THEN 'quota' WHEN status >= 500 THEN 'server' ELSE 'other' END AS class
FROM (SELECT event_id, [200, 402, 429, 500, 503][event_id % 5 + 1] AS status, CASE WHEN event_id % 7 = 0 THEN 'billing hard limit' ELSE event_type END AS body FROM events)""")
def billing_errors(spark, sf):
    """Errors by status and body; a rate limit with a wait is to be retried."""
    k = F.col("event_id")
    status = F.element_at(F.array(*(F.lit(x) for x in (200, 402, 429, 500, 503))), (k % 5 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", status.alias("status"), F.when(k % 7 == 0, "billing hard limit").otherwise(F.col("event_type")).alias("body"))
    s = F.col("status")
    kind = F.when((s == 402) | F.col("body").rlike("quota|billing|credit"), "billing").when((s == 429) & (k % 2 == 0), "retry").when(s == 429, "quota").when(s >= 500, "server").otherwise("other")
    return e.select("event_id", kind.alias("class"))


@operator(f"""WITH {VERSIONS} SELECT version_id, kind NOT IN ('1-URGENT', '5-LOW') AND NOT (kind = '2-HIGH' AND importance > 7) AS revisable,
  importance > 5 OR abs(epoch(valid_from) - epoch(recorded_at)) > 300 AS reviewable FROM versions""")
def revisable_reviewable(spark, sf):
    """Which kinds may be edited, and which rows are dated well enough to be reviewed."""
    kind, imp = F.col("kind"), F.col("importance")
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    gap = F.abs(seconds("valid_from") - seconds("recorded_at")) > 300
    return versions(spark, sf).select("version_id", (~kind.isin("1-URGENT", "5-LOW") & ~((kind == "2-HIGH") & (imp > 7))).alias("revisable"), ((imp > 5) | gap).alias("reviewable"))


_LIVE = "list_contains(project_ids, 27) AND device_scope IN ('all', 'class:work') AND valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR TIMESTAMP '1996-06-01' < valid_to) AND recorded_at <= TIMESTAMP '1997-01-01' AND (superseded_at IS NULL OR TIMESTAMP '1997-01-01' < superseded_at)"


def _live():
    return P.authz(27, ["all", "class:work"]) & P.temporal_live("1996-06-01", "1997-01-01")


@operator(f"""WITH {VERSIONS}, p AS (SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS parts FROM lineitem GROUP BY l_orderkey), c AS (SELECT DISTINCT 'v' || l_orderkey || CASE WHEN l_linenumber > 1 THEN '.' || (l_linenumber - 2 + l_partkey % 3) ELSE '' END AS clue, l_orderkey AS id, CASE WHEN l_linenumber > 1 THEN l_linenumber - 2 + l_partkey % 3 END AS ordinal FROM lineitem)
SELECT clue, version_id, kind, CASE WHEN ordinal IS NULL THEN 'item' WHEN ordinal < parts THEN 'part' ELSE 'no-such-part' END AS stands_for FROM c JOIN versions ON version_id = c.id JOIN p ON p.id = c.id WHERE {_LIVE} AND status IN ('F', 'O')""")
def live_under_clue(spark, sf):
    """What clues stand for, if it may be seen, was valid and known then, and has an allowed status: an item, a part of it by ordinal, or a part that it hasn't got."""
    li = table(spark, sf, "lineitem")
    part = F.concat(F.lit("."), (F.col("l_linenumber") - 2 + F.col("l_partkey") % 3).cast("string"))
    c = li.select(F.concat(F.lit("v"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") > 1, part).otherwise("")).alias("clue")).distinct()
    number = lambda pattern: F.nullif(F.regexp_extract("clue", pattern, 1), F.lit("")).cast("long")
    c = c.select("clue", number(r"^v([0-9]+)").alias("version_id"), number(r"\.([0-9]+)$").alias("ordinal"))
    parts = li.groupBy(F.col("l_orderkey").alias("version_id")).agg(F.count_distinct("l_linenumber").alias("parts"))
    stands = F.when(F.col("ordinal").isNull(), "item").when(F.col("ordinal") < F.col("parts"), "part").otherwise("no-such-part")
    live = versions(spark, sf).where(_live() & F.col("status").isin("F", "O"))
    return c.join(live, "version_id").join(parts, "version_id").select("clue", "version_id", "kind", stands.alias("stands_for"))


@operator(f"WITH {VERSIONS}, a AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT src, dst, src IN (SELECT version_id FROM versions WHERE {_LIVE}) AS src_visible, dst IN (SELECT logical_id FROM versions WHERE {_LIVE}) AS dst_visible FROM a")
def endpoint_authz(spark, sf):
    """Which ends of a link may be seen, versions and items."""
    v = versions(spark, sf).where(_live())
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    s = v.select(F.col("version_id").alias("src")).distinct().withColumn("s", F.lit(True))
    d = v.select(F.col("logical_id").alias("dst")).distinct().withColumn("d", F.lit(True))
    return a.join(s, "src", "left").join(d, "dst", "left").select("src", "dst", F.coalesce("s", F.lit(False)).alias("src_visible"), F.coalesce("d", F.lit(False)).alias("dst_visible"))


@operator(f"WITH {VERSIONS}, r AS (SELECT version_id, row_number() OVER (PARTITION BY logical_id ORDER BY weight DESC, version_id) AS rank FROM versions) SELECT version_id, CAST(rank AS INTEGER) AS rank FROM r SEMI JOIN (SELECT version_id FROM versions WHERE {_LIVE}) USING (version_id) WHERE rank <= 5")
def still_visible(spark, sf):
    """Of what was returned, what may still be seen."""
    w = Window.partitionBy("logical_id").orderBy(F.col("weight").desc(), "version_id")
    v = versions(spark, sf)
    return v.select("version_id", F.row_number().over(w).alias("rank")).where("rank <= 5").join(v.where(_live()).select("version_id"), "version_id", "left_semi")


@operator("""SELECT o_orderkey, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20) AS last_ship, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) > 2 AS stale FROM orders""")
def correlated_scalars(spark, sf):
    """Scalar subqueries of each row, which Catalyst turns into one aggregate and an outer join each."""
    table(spark, sf, "lineitem").createOrReplaceTempView("cs_lineitem")
    table(spark, sf, "orders").createOrReplaceTempView("cs_orders")
    return spark.sql("""SELECT o_orderkey, (SELECT max(l_shipdate) FROM cs_lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20) AS last_ship,
      coalesce((SELECT count(*) FROM cs_lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05), 0) > 2 AS stale FROM cs_orders""")


_ROWS = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS"


@operator(f"""SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey % 7) OVER ({_ROWS} UNBOUNDED PRECEDING) AS BIGINT) AS running, CAST(sum(o_orderkey % 7) OVER ({_ROWS} BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near,
  CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS month FROM orders""")
def frame_specs(spark, sf):
    """Frames by rows, by neighbours and by a range of time."""
    o = table(spark, sf, "orders").withColumn("p", F.col("o_orderkey") % 7).withColumn("s", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    r = Window.partitionBy("o_custkey").orderBy("s").rangeBetween(-30 * 86400, 0)
    return o.select("o_custkey", "o_orderkey", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.sum("p").over(w.rowsBetween(-1, 1)).alias("near"), F.count("*").over(r).alias("month"))
