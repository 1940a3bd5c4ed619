"""Projections of the event log: versions, links and chunks, rebuilt from all of it or kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import prepare, stored
from tidemark.sources.versioned import Versioned

#: Events that open a version of an item, one that ends it, and one that touches it; a user's item is a seventh of the keys in the event's properties.
WRITES, CLOSE, TOUCH = ("purchase", "signup"), "error", "click"
SLOTS = 7
#: Characters of a chunk, and batches after which versions are compacted.
PIECE, COMPACT = 8, 8
VERSION = "version_id long, user_id long, slot long, opened_at timestamp_ntz, closed_at timestamp_ntz, status string, touched timestamp_ntz, accesses long, seq long"
LINK = "src long, dst long, kind string, at timestamp_ntz, seq long"
CHUNK = "version_id long, ordinal int, text string, seq long"


def fold(events: DataFrame, carried: DataFrame, seq: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, links, chunks) that events (event_id, ts, user_id, event_type, props) make of the versions that were open before (as VERSION).

    A write opens a version of its item and supersedes the open one, to which it is linked; a close ends it; a touch counts for the version that is open. The log's order is
    that of event_id.
    """
    e = events.where(F.col("event_type").isin(*WRITES, CLOSE, TOUCH)).withColumn("slot", F.get_json_object("props", "$.k").cast("long") % SLOTS)
    e = e.select("event_id", "ts", "user_id", "slot", "event_type", "props", F.lit(None).cast("timestamp_ntz").alias("touched"), F.lit(0).cast("long").alias("accesses"))
    before = carried.select(F.col("version_id").alias("event_id"), F.col("opened_at").alias("ts"), "user_id", "slot", F.lit("carried").alias("event_type"), F.lit(None).cast("string").alias("props"), "touched", "accesses")
    s = e.unionByName(before)
    w = Window.partitionBy("user_id", "slot").orderBy("event_id")
    is_state, is_open = F.col("event_type") != TOUCH, F.col("event_type").isin(*WRITES, "carried")
    s = s.withColumn("current", F.last(F.when(is_state, F.col("event_id")), ignorenulls=True).over(w))
    near = F.struct("event_id", "ts", "event_type")
    st = s.where(is_state).withColumns({"nxt": F.lead(near).over(w), "prv": F.lag(near).over(w)})
    hits = s.where(~is_state).groupBy(F.col("current").alias("event_id")).agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    v = st.where(is_open).join(hits, "event_id", "left")
    status = F.when(F.col("nxt").isNull(), "open").when(F.col("nxt.event_type") == CLOSE, "closed").otherwise("superseded")
    n = F.lit(seq).cast("long").alias("seq")
    versions = v.select(F.col("event_id").alias("version_id"), "user_id", "slot", F.col("ts").alias("opened_at"), F.col("nxt.ts").alias("closed_at"), status.alias("status"), F.greatest("touched", "last").alias("touched"), (F.col("accesses") + F.coalesce("n", F.lit(0))).alias("accesses"), n)
    new = st.where(F.col("event_type").isin(*WRITES))
    linked = new.where(F.col("prv.event_type").isin(*WRITES, "carried"))
    links = linked.select(F.col("event_id").alias("src"), F.col("prv.event_id").alias("dst"), F.when(F.col("event_type") == "signup", "derived_from").otherwise("supersedes").alias("kind"), F.col("ts").alias("at"), n)
    body = F.concat_ws(":", "event_type", "props")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(body) - 1) / PIECE).cast("int")), lambda i: F.substring(body, i * PIECE + 1, F.lit(PIECE)))
    chunks = new.select(F.col("event_id").alias("version_id"), F.posexplode(pieces).alias("ordinal", "text"), n)
    return versions, links, chunks


class Projections:
    """The three projections as versioned tables below ``folder``. The same folder goes on where an earlier run ended."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        prepare(spark)
        self.folder = folder
        self.versions = Versioned(spark, f"{folder}/versions", VERSION, ["version_id"], "seq")
        self.links = Versioned(spark, f"{folder}/links", LINK, ["src", "dst"], "seq")
        self.chunks = Versioned(spark, f"{folder}/chunks", CHUNK, ["version_id", "ordinal"], "seq")

    def put(self, batch: DataFrame, number: int, written: Callable[[], None] = lambda: None) -> None:
        """Fold a batch into the tables as of the batch before it, so that one that comes twice, or again after it failed half-way, changes nothing more."""
        batch = stored(batch)
        was = self.versions.read(number - 1).where("status = 'open'")
        keys = batch.select("user_id").distinct()
        versions, links, chunks = fold(batch, was.join(keys, "user_id", "left_semi"), number)
        self.links.merge(links, number)
        self.chunks.merge(chunks, number, written)
        self.versions.merge(versions, number)
        if number % COMPACT == COMPACT - 1:
            for t in (self.versions, self.links, self.chunks):
                t.compact()

    def run(self, stream: DataFrame, written: Callable[[], None] = lambda: None) -> None:
        """Fold all that the stream has not given yet."""
        q = stream.writeStream.foreachBatch(lambda b, n: self.put(b, n, written)).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    def rows(self) -> DataFrame:
        return tall(self.versions.read(), self.links.read(), self.chunks.read())


def tall(versions: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """The three projections as one table (rec, a, b, note, since, until, touched, n)."""
    none = F.lit(None).cast("timestamp_ntz")
    v = versions.select(F.lit("version").alias("rec"), F.col("version_id").alias("a"), (F.col("user_id") * SLOTS + F.col("slot")).alias("b"), F.col("status").alias("note"), F.col("opened_at").alias("since"), F.col("closed_at").alias("until"), "touched", F.col("accesses").alias("n"))
    k = links.select(F.lit("link").alias("rec"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("kind").alias("note"), F.col("at").alias("since"), none.alias("until"), none.alias("touched"), F.lit(None).cast("long").alias("n"))
    c = chunks.select(F.lit("chunk").alias("rec"), F.col("version_id").alias("a"), F.col("ordinal").cast("long").alias("b"), F.col("text").alias("note"), none.alias("since"), none.alias("until"), none.alias("touched"), F.lit(None).cast("long").alias("n"))
    return v.unionByName(k).unionByName(c)
