"""Leases on jobs with fence tokens: who may work on a job, until when, and which requests come too late."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds of a lease, seconds of wait after each failure, and attempts after which a job is dead.
LEASE, BACKOFF, ATTEMPTS = 300, (60, 120, 240, 480, 960), 5
REQUEST = "job long, seq long, at timestamp, kind string, worker long, token long"
OUTCOME = "job long, seq long, at timestamp, outcome string, worker long, token long, attempts int"
_STATE = "status string, token long, worker long, lease_until long, due long, attempts int, timer long, first long"
#: Requests that came together are one element, as reading and writing state costs by its elements; of this many at most.
_WAITING = "seq array<long>, at array<long>, kind array<string>, worker array<long>, token array<long>"
_TOGETHER = 10_000
_MICRO = 1_000_000


@dataclass
class Job:
    """A job between requests; instants are microseconds, a timer is set for ``timer`` milliseconds (0: none), and ``first`` is the instant of its first waiting request."""

    status: str = "none"
    token: int = 0
    worker: int = -1
    lease_until: int = 0
    due: int = 0
    attempts: int = 0
    timer: int = 0
    first: int | None = None

    def _lost(self, at: int, wait: int) -> str:
        self.attempts += 1
        dead = self.attempts >= ATTEMPTS
        self.status, self.due = ("dead", 0) if dead else ("queued", at + wait * _MICRO)
        return "dead" if dead else "retry" if wait else "expired"

    def expire(self, upto: int) -> list[tuple]:
        """A lease that has run out by ``upto`` ends at its own instant, and the job can be had again at once, or is dead."""
        if self.status != "running" or self.lease_until > upto:
            return []
        at, worker = self.lease_until, self.worker
        return [(-1, at, self._lost(at, 0), worker, self.token, self.attempts)]

    def step(self, seq: int, at: int, kind: str, worker: int, token: int | None) -> list[tuple]:
        """The outcomes of one request; a lease that ran out before it ends first. Only the holder's token, or without one its name, counts."""
        out = self.expire(at)
        holds = self.status == "running" and (token == self.token if token is not None else worker == self.worker)
        outcome = "refused"
        if kind == "enqueue" and self.status == "none":
            self.status, self.due, outcome = "queued", at, "queued"
        elif kind == "claim" and self.status == "queued" and self.due <= at:
            self.status, self.token, self.worker, self.lease_until, outcome = "running", self.token + 1, worker, at + LEASE * _MICRO, "granted"
        elif kind == "claim" and self.status in ("queued", "running"):
            outcome = "wait"
        elif kind == "renew" and holds:
            self.lease_until, outcome = at + LEASE * _MICRO, "renewed"
        elif kind == "done" and holds:
            self.status, outcome = "done", "done"
        elif kind == "fail" and holds:
            outcome = self._lost(at, BACKOFF[min(self.attempts, len(BACKOFF) - 1)])
        return [*out, (seq, at, outcome, worker, self.token, self.attempts)]


class Leases(StatefulProcessor):
    """Requests wait until the watermark has passed them and are taken in order of time and number, so that no split into batches changes an outcome."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)
        self.waiting = handle.getListState("waiting", _WAITING)

    def _state(self) -> Job:
        row = self.job.get()
        return Job(*row) if row else Job()

    def _put(self, job: Job) -> None:
        """The state, with one timer, for the next request or the end of the lease; of a millisecond that is not over before them."""
        nxt = min([x for x in (job.first, job.lease_until if job.status == "running" else None) if x is not None], default=None)
        at = 0 if nxt is None else -(-nxt // 1000)
        if at != job.timer:
            if job.timer:
                self.handle.deleteTimer(job.timer)
            if at:
                self.handle.registerTimer(at)
            job.timer = at
        self.job.update(tuple(vars(job).values()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = self._state()
        for f in rows:
            at = (f["at"].to_numpy("datetime64[ns]").astype("int64") // 1000).tolist()
            worker, token = ([None if x is None or x != x else int(x) for x in f[c].tolist()] for c in ("worker", "token"))
            self.waiting.appendValue((f["seq"].tolist(), at, f["kind"].tolist(), worker, token))
            job.first = min(at if job.first is None else [job.first, *at])
        self._put(job)
        return iter(())  # outcomes come by timer; a frame without rows would be paid for as one with rows

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        job = self._state()
        job.timer = 0  # it has just gone off
        out: list[tuple] = []
        if job.first is not None and job.first <= upto:
            rows = [r for x in self.waiting.get() for r in zip(*x, strict=True)]
            rows.sort(key=lambda r: (r[1], r[0], *((x is not None, x) for x in r[2:])))
            due = bisect_right(rows, upto, key=lambda r: r[1])
            for r in rows[:due]:
                out += job.step(*r)
            rest = rows[due:]
            if rest:
                self.waiting.put([tuple(map(list, zip(*rest[i : i + _TOGETHER], strict=True))) for i in range(0, len(rest), _TOGETHER)])
            else:
                self.waiting.clear()
            job.first = rest[0][1] if rest else None
        out += job.expire(upto)
        self._put(job)
        if out:
            seq, at, outcome, worker, token, attempts = zip(*out, strict=True)
            long = lambda x: np.array(x, "int64")
            workers = worker if None in worker else long(worker)
            yield pd.DataFrame({"job": key[0], "seq": long(seq), "at": pd.to_datetime(long(at), unit="us"), "outcome": np.array(outcome, "object"), "worker": workers, "token": long(token), "attempts": np.array(attempts, "int32")})

    def close(self) -> None:
        pass


def outcomes(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows of OUTCOME for a stream of REQUEST rows: what became of each request that the watermark has passed, and of leases that ran out (seq -1).

    Kinds: enqueue, claim, renew, done, fail. A claim grants a job that is queued and due, with the next token; renew, done and fail count for the holder only.
    A failed job waits, longer each time; after ATTEMPTS losses it is dead. Rows later than the watermark are left out by Spark.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = requests.where(F.col("job").isNotNull()).withWatermark("at", late)
    return r.groupBy("job").transformWithStateInPandas(Leases(), OUTCOME, "Append", "EventTime")
