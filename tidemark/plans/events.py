"""Event log: queues, windows, limits, replay; batch plans with SQL, and the same as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.registry import operator
from tidemark.session import checkpoint_dir, prepare
from tidemark.sources.tables import table
from tidemark.streaming import jobs, leases, projections


def ev(spark, sf):
    return table(spark, sf, "events")


@operator("SELECT event_id, user_id FROM (SELECT *, event_type = 'view' AND ts <= TIMESTAMP '2024-01-20' OR event_type = 'click' AND ts + INTERVAL 300 SECOND <= TIMESTAMP '2024-01-20' AS ready FROM events) WHERE ready ORDER BY user_id % 3, ts, event_id LIMIT 100")
def outbox_ready(spark, sf):
    """Queued and due, or running with an expired lease; the next hundred by priority, due time and id."""
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    ready = ((F.col("event_type") == "view") & (F.col("ts") <= now)) | ((F.col("event_type") == "click") & (F.expr("ts + INTERVAL 300 SECOND") <= now))
    return ev(spark, sf).where(ready).orderBy(F.col("user_id") % 3, "ts", "event_id").limit(100).select("event_id", "user_id")


@operator("SELECT user_id, arg_max(event_type, event_id) AS state, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS attempts, [1, 2, 4, 8, 16][greatest(1, least(5, count(*) FILTER (event_type = 'error')))] AS wait, count(*) FILTER (event_type = 'error') >= 20 AS dead FROM events GROUP BY user_id")
def job_transitions(spark, sf):
    """The last state of each job, attempts, and the wait before the next."""
    a = F.count_if(F.col("event_type") == "error")
    back = F.element_at(F.array(*(F.lit(x) for x in (1, 2, 4, 8, 16))), F.greatest(F.lit(1), F.least(F.lit(5), F.col("attempts"))).cast("int"))
    g = ev(spark, sf).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), a.alias("attempts"))
    return g.select("user_id", "state", "attempts", back.alias("wait"), (F.col("attempts") >= 20).alias("dead"))


@operator("WITH r AS (SELECT user_id, event_type, round(value) AS req, event_id, md5(props) AS h FROM events), f AS (SELECT *, first_value(h) OVER (PARTITION BY user_id, event_type, req ORDER BY event_id) AS h0, row_number() OVER (PARTITION BY user_id, event_type, req ORDER BY event_id) AS rn FROM r) SELECT event_id, CASE WHEN rn = 1 THEN 'accepted' WHEN h = h0 THEN 'replayed' ELSE 'conflict' END AS outcome FROM f")
def idempotent_dedupe(spark, sf):
    """I4, K7: the first request wins; the same again is a replay, another payload a conflict."""
    w = Window.partitionBy("user_id", "event_type", F.round("value")).orderBy("event_id")
    h = F.md5(F.col("props").cast("binary"))
    r = ev(spark, sf).select("event_id", h.alias("h"), F.first(h).over(w).alias("h0"), F.row_number().over(w).alias("rn"))
    return r.select("event_id", F.when(F.col("rn") == 1, "accepted").when(F.col("h") == F.col("h0"), "replayed").otherwise("conflict").alias("outcome"))


@operator("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, CAST(sid AS BIGINT) AS sid, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, sid")
def sessions(spark, sf):
    """Sessions by a gap of six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when((F.col("ts") - F.lag("ts").over(w)) <= F.expr("INTERVAL 6 HOUR"), 0).otherwise(1)
    s = ev(spark, sf).withColumn("new", new).withColumn("sid", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy("user_id", "sid").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


_HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS spent FROM events GROUP BY ALL"


@operator(_HOURS)
def tumbling_spend(spark, sf):
    """Spend by hour."""
    g = ev(spark, sf).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spent"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "spent")


@operator("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS hits FROM events")
def sliding_rate(spark, sf):
    """Hits of a key in the trailing day."""
    sec = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(sec).rangeBetween(-86_400_000_000, 0)
    return ev(spark, sf).select("event_id", F.count("*").over(w).alias("hits"))


@operator("WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS grp FROM events), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS run FROM g WHERE event_type = 'error') SELECT user_id, event_id, CAST(run AS BIGINT) AS run FROM r WHERE run >= 3")
def breaker_runs(spark, sf):
    """Failures that make a run of three or more."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bad = F.col("event_type") == "error"
    g = ev(spark, sf).withColumn("grp", F.row_number().over(w) - F.row_number().over(Window.partitionBy("user_id", bad).orderBy("ts", "event_id"))).where(bad)
    return g.withColumn("run", F.row_number().over(Window.partitionBy("user_id", "grp").orderBy("ts", "event_id")).cast("long")).where("run >= 3").select("user_id", "event_id", "run")


@operator("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts FROM events WHERE event_type = 'purchase') WHERE n <= 5 AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-15'")
def ceiling_and_ttl(spark, sf):
    """Calls under a ceiling for each key, not expired."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = ev(spark, sf).where("event_type = 'purchase'").withColumn("n", F.row_number().over(w))
    return p.where("n <= 5 AND ts + INTERVAL 10 DAY > TIMESTAMP_NTZ '2024-01-15'").select("event_id")


@operator("""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS slot FROM events WHERE event_type IN ('signup', 'purchase', 'error')), v AS (SELECT event_id, user_id, slot, event_type, lead(ts) OVER (PARTITION BY user_id, slot ORDER BY ts, event_id) AS closed_at, ts FROM e)
SELECT event_id, user_id, slot, ts AS opened_at, closed_at FROM v WHERE event_type <> 'error'""")
def replay_projection(spark, sf):
    """The projection rebuilt from the log: each event opens a row of its slot and closes the one before; errors close only."""
    e = ev(spark, sf).where("event_type IN ('signup', 'purchase', 'error')").withColumn("slot", F.get_json_object("props", "$.k").cast("long") % 7)
    v = e.withColumn("closed_at", F.lead("ts").over(Window.partitionBy("user_id", "slot").orderBy("ts", "event_id")))
    return v.where("event_type <> 'error'").select("event_id", "user_id", "slot", F.col("ts").alias("opened_at"), "closed_at")


@operator("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_latest(spark, sf):
    """The newest row of each key, kept by foreachBatch."""
    return jobs.latest(jobs.source(spark, sf).select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@operator("SELECT user_id, event_id, run FROM (WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS grp FROM events), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS run FROM g WHERE event_type = 'error') SELECT * FROM r WHERE run >= 3)")
def stream_breaker(spark, sf):
    """The same runs of failures with state kept between batches."""
    return jobs.run(jobs.breaker(jobs.source(spark, sf)))


@operator("SELECT event_id, user_id, event_type FROM events")
def stream_once(spark, sf):
    """I4: a log in which events come again, at once and later, with duplicates dropped inside the watermark."""
    folder = f"{checkpoint_dir(prepare(spark))}/twice-{uuid.uuid4().hex}"
    e = ev(spark, sf)
    e.unionAll(e.where("value > 50")).write.parquet(folder)
    e.where("event_type = 'click'").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1 << 20).parquet(folder)
    return jobs.run(jobs.once(stream).select("event_id", "user_id", "event_type"))


@operator("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS spent FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 30 MINUTE FROM events) GROUP BY ALL")
def stream_tumbling(spark, sf):
    """Closed hours of the stream; hours that the watermark hasn't passed aren't out yet."""
    return jobs.run(jobs.tumbling(jobs.source(spark, sf)))


_PROJECTIONS = """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS slot FROM events WHERE event_type IN ('purchase', 'signup', 'error', 'click')),
c AS (SELECT *, max(CASE WHEN event_type <> 'click' THEN event_id END) OVER (PARTITION BY user_id, slot ORDER BY event_id) AS cur FROM e),
h AS (SELECT cur, max(ts) AS last, count(*) AS n FROM c WHERE event_type = 'click' GROUP BY cur),
s AS (SELECT *, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type, lag(event_id) OVER w AS prev, lag(event_type) OVER w AS prev_type FROM e WHERE event_type <> 'click' WINDOW w AS (PARTITION BY user_id, slot ORDER BY event_id)),
b AS (SELECT event_id, event_type || ':' || props AS body FROM s WHERE event_type <> 'error')
SELECT 'version' AS rec, event_id AS a, user_id * 7 + slot AS b, CASE WHEN next_type IS NULL THEN 'open' WHEN next_type = 'error' THEN 'closed' ELSE 'superseded' END AS note, ts AS since, next_ts AS until, last AS touched, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM s LEFT JOIN h ON cur = event_id WHERE event_type <> 'error'
UNION ALL SELECT 'link', event_id, prev, CASE event_type WHEN 'signup' THEN 'derived_from' ELSE 'supersedes' END, ts, NULL, NULL, NULL FROM s WHERE event_type <> 'error' AND prev_type <> 'error'
UNION ALL SELECT 'chunk', event_id, i, substr(body, CAST(i * 8 + 1 AS BIGINT), 8), NULL, NULL, NULL, NULL FROM b, unnest(range(0, (length(body) + 7) // 8)) AS u(i)"""


@operator(_PROJECTIONS)
def projection_rebuild(spark, sf):
    """Versions, links and chunks rebuilt from the whole log."""
    e = ev(spark, sf)
    return projections.tall(*projections.fold(e, spark.createDataFrame([], projections.VERSION)))


@operator(_PROJECTIONS)
def projection_stream(spark, sf):
    """The same kept up to date by a stream of the log in four parts, with upserts into versioned tables."""
    folder = f"{checkpoint_dir(prepare(spark))}/projections-{uuid.uuid4().hex}"
    e = ev(spark, sf)
    lo, hi = e.agg(F.min("event_id"), F.max("event_id")).first()
    cuts = [] if lo is None else [lo + (hi - lo + 1) * k // 4 for k in range(5)]
    e.limit(0).write.parquet(f"{folder}/log")
    for a, b in zip(cuts, cuts[1:], strict=False):
        e.where((F.col("event_id") >= a) & (F.col("event_id") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    p = projections.Projections(spark, folder)
    p.run(spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log"))
    return p.rows()


@operator()
def lease_log(spark, sf):
    """The log read as requests for leases (a user is a job, three workers): grants with fence tokens, renewals, expiry by timers, refusals, waits and dead jobs."""
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("signup", "enqueue", "view", "claim", "click", "renew", "purchase", "done", "error", "fail"))), F.col("event_type")), F.lit("none"))
    k = F.get_json_object("props", "$.k").cast("long")
    r = jobs.source(spark, sf).select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), (k % 3).alias("worker"), F.lit(None).cast("long").alias("token"))
    return jobs.run(leases.outcomes(r))
