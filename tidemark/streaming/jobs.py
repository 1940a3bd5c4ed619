"""Structured Streaming over the event log: each job runs until all files are read, keeps its state in the checkpoint folder and can go on from there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import checkpoint_dir, prepare
from tidemark.sources.versioned import Versioned

#: Batches after which changes are merged.
COMPACT = 16
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str, files_at_once: int = 8) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Write a stream to Parquet until its source is read up, and give the result. The same folder goes on where an earlier run ended."""
    spark = prepare(stream.sparkSession)
    folder = folder or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def latest(stream: DataFrame, key: list[str], order: str, folder: str | None = None) -> DataFrame:
    """The newest row of each key, in a versioned table below ``folder``: a batch commits its own newest rows under its number, so one that comes again changes
    nothing, and the same folder goes on where an earlier run ended. Every COMPACT batches the changes become a base."""
    spark = prepare(stream.sparkSession)
    folder = folder or f"{checkpoint_dir(spark)}/latest-{uuid.uuid4().hex}"
    kept = Versioned(spark, f"{folder}/table", stream.schema, key, order)
    rest = [c for c in stream.columns if c not in key]

    def put(batch: DataFrame, number: int) -> None:
        kept.merge(batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, "x.*"), number)
        if number % COMPACT == COMPACT - 1:
            kept.compact()

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return kept.read()


def tumbling(stream: DataFrame, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Spend and counts by hour and type; windows close once the watermark passes them, and later rows are left to the bi-temporal tables."""
    w = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("spent")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "spent")


def sliding(stream: DataFrame, size: str = "30 minutes", step: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and spend by overlapping windows and type."""
    w = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", size, step), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("spent")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "spent")


def sessions(stream: DataFrame, gap: str = "20 minutes", late: str = "30 minutes") -> DataFrame:
    """A user's sessions, each ended by a gap without events: first and last instant, and the number of events."""
    w = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id")
    return w.agg(F.max("at").alias("last"), F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Idempotent ingest: the first row of each request id inside the watermark."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def breaker(stream: DataFrame, limit: int = 3) -> DataFrame:
    """(user_id, event_id, run): failures that make a run of ``limit`` consecutive errors or more of a user; the run's length is kept as state between batches."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for i, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            n = n + 1 if kind == "error" else 0
            if n >= limit:
                out.append((key[0], i, n))
        state.update((n,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "run"])

    return stream.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, run long", "n long", "append", GroupStateTimeout.NoTimeout)
