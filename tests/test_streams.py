"""Streams and versioned tables: repeats, restarts, jobs that end half-way."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from tidemark.sources.versioned import Versioned
from tidemark.streaming import jobs, leases, projections


def log(seed, n, users=4):
    r = random.Random(seed)
    at = datetime.datetime(2024, 1, 1)
    kinds = ["purchase", "signup", "error", "click", "click", "view"]
    return [(i, at + datetime.timedelta(minutes=i), r.randrange(users), r.choice(kinds), 1.0, f'{{"k": {r.randrange(9)}}}') for i in range(n)]


def plain(events):
    """The projections by a loop over the log."""
    versions, links, chunks, current = {}, [], [], {}
    for i, at, user, kind, _, props in events:
        item = (user, int(props[6:-1]) % 7)
        if kind in ("purchase", "signup", "error") and item in current:
            v = versions[current[item]]
            v[2:4] = at, "closed" if kind == "error" else "superseded"
        if kind in ("purchase", "signup"):
            if item in current:
                links.append((i, current[item], "derived_from" if kind == "signup" else "supersedes"))
            versions[i] = [item, at, None, "open", None, 0]
            body = f"{kind}:{props}"
            chunks += [(i, k // 8, body[k : k + 8]) for k in range(0, len(body), 8)]
            current[item] = i
        elif kind == "error":
            current.pop(item, None)
        elif kind == "click" and item in current:
            versions[current[item]][4:] = at, versions[current[item]][5] + 1
    return versions, links, chunks


def check(p, events):
    versions, links, chunks = plain(events)
    got = {r.version_id: [(r.user_id, r.slot), r.opened_at, r.closed_at, r.status, r.touched, r.accesses] for r in p.versions.read().collect()}
    assert got == versions
    assert sorted((r.src, r.dst, r.kind) for r in p.links.read().collect()) == sorted(links)
    assert sorted((r.version_id, r.ordinal, r.text) for r in p.chunks.read().collect()) == sorted(chunks)


def frame(spark, events):
    return spark.createDataFrame(events, jobs.EVENTS)


def parts(spark, events, folder, n):
    frame(spark, []).write.parquet(folder)
    for k in range(n):
        frame(spark, events[k * len(events) // n : (k + 1) * len(events) // n]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_projections_after_a_job_that_ended_between_writing_and_committing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(projections, "COMPACT", 3)
    events = log(1, 300)
    stream = parts(spark, events, f"{tmp_path}/log", 5)
    calls = []

    def fail():
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the job ends here")

    p = projections.Projections(spark, f"{tmp_path}/p")
    with pytest.raises(StreamingQueryException):
        p.run(stream, fail)
    assert p.links.last() == 2 and p.chunks.last() == 1 and p.versions.last() == 1
    again = projections.Projections(spark, f"{tmp_path}/p")
    again.run(stream)
    check(again, events)
    assert {k for k, _, _ in again.versions.log()} == {"base", "change"}


def test_a_batch_sent_twice_and_an_empty_one(spark, tmp_path):
    events = log(2, 200)
    p = projections.Projections(spark, str(tmp_path))
    for k in range(4):
        for _ in range(2):
            p.put(frame(spark, events[k * 50 : (k + 1) * 50]), k)
    p.put(frame(spark, []), 4)
    check(p, events)
    p.put(frame(spark, events[100:150]), 2)  # an old one, once more
    check(p, events)
    assert p.versions.read(1).count() == len(plain(events[:100])[0])


def test_upserts_deletes_and_compaction(spark, tmp_path):
    t = Versioned(spark, str(tmp_path), "k int, v string, seq long, deleted boolean", ["k"], "seq")
    put = lambda rows, n: t.merge(spark.createDataFrame(rows, "k int, v string, seq long, deleted boolean"), n)
    assert t.read().count() == 0 and t.last() == -1
    assert put([(1, "a", 0, False), (2, "b", 0, False)], 0) and put([(1, "c", 1, False), (2, "b", 1, True), (3, "d", 1, None)], 1)
    now = {(1, "c"), (3, "d")}
    assert {(r.k, r.v) for r in t.read().collect()} == now
    t.compact()
    t.compact()
    assert {(r.k, r.v) for r in t.read().collect()} == now and [k for k, _, _ in t.log()].count("base") == 1
    assert not put([(9, "x", 9, False)], 1) and put([(1, "e", 2, False)], 2)
    assert {(r.k, r.v) for r in t.read().collect()} == {(1, "e"), (3, "d")}
    assert {(r.k, r.v) for r in t.read(0).collect()} == {(1, "a"), (2, "b")}


def naive_leases(requests, upto):
    """What becomes of all requests and leases up to an instant, one job after the other."""
    out = []
    second = 1_000_000
    for job in {r[0] for r in requests}:
        state = {"s": "none", "token": 0, "lost": 0}
        todo = sorted((r[2], r[1], *r[3:]) for r in requests if r[0] == job and r[2] <= upto)

        def lose(at, wait, worker, seq):
            state["lost"] += 1
            dead = state["lost"] >= 5
            state.update(s="dead") if dead else state.update(s="queued", due=at + wait * second)
            out.append((job, seq, at, "dead" if dead else "retry" if wait else "expired", worker, state["token"], state["lost"]))

        for at, seq, kind, worker, token in [*todo, (upto, None, None, None, None)]:
            if state["s"] == "running" and state["until"] <= at:
                lose(state["until"], 0, state["worker"], -1)
            if seq is None:
                continue
            mine = state["s"] == "running" and (state["token"] == token if token is not None else state["worker"] == worker)
            said = "refused"
            if kind == "enqueue" and state["s"] == "none":
                state.update(s="queued", due=at)
                said = "queued"
            elif kind == "claim" and state["s"] == "queued" and state["due"] <= at:
                state.update(s="running", token=state["token"] + 1, worker=worker, until=at + 300 * second)
                said = "granted"
            elif kind == "claim" and state["s"] in ("queued", "running"):
                said = "wait"
            elif kind == "renew" and mine:
                state["until"] = at + 300 * second
                said = "renewed"
            elif kind == "done" and mine:
                state["s"] = said = "done"
            elif kind == "fail" and mine:
                lose(at, (60, 120, 240, 480, 960)[min(state["lost"], 4)], worker, seq)
                continue
            out.append((job, seq, at, said, worker, state["token"], state["lost"]))
    return sorted(out)


def requests(seed, n):
    r = random.Random(seed)
    start = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)
    out, t = [], 0
    for i in range(n):
        t += r.randrange(0, 40)
        kind = r.choices(["enqueue", "claim", "renew", "done", "fail"], [3, 6, 8, 1, 4])[0]
        out.append((r.randrange(14), i, start + datetime.timedelta(seconds=t), kind, r.randrange(3), r.choice([None, None, 1, 2, 3])))
    return out


@pytest.mark.parametrize("restart", [False, True])
def test_leases_as_a_plain_state_machine(spark, tmp_path, restart):
    rows = requests(5, 400)
    shuffled = [x for k in range(0, 400, 5) for x in random.Random(k).sample(rows[k : k + 5], 5)]  # a little out of order, within the watermark
    folder = f"{tmp_path}/in"
    put = lambda part: spark.createDataFrame(part, leases.REQUEST).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: leases.outcomes(spark.readStream.schema(leases.REQUEST).option("maxFilesPerTrigger", 1).parquet(folder))
    for k in range(4):
        put(shuffled[k * 100 : (k + 1) * 100])
        if restart:
            got = jobs.run(stream(), folder=f"{tmp_path}/out")
    got = jobs.run(stream(), folder=f"{tmp_path}/out") if not restart else got
    micros = lambda d: int((d - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)).total_seconds() * 1_000_000)
    upto = (micros(max(r[2] for r in rows)) - 600 * 1_000_000) // 1000 * 1000
    want = naive_leases([(r[0], r[1], micros(r[2]), *r[3:]) for r in rows], upto)
    have = sorted((r.job, r.seq, micros(r.at.replace(tzinfo=datetime.timezone.utc)), r.outcome, r.worker, r.token, r.attempts) for r in got.collect())
    assert {x[3] for x in want} == {"queued", "granted", "wait", "renewed", "done", "retry", "expired", "dead", "refused"}
    assert have == want


class Handle:
    """A state handle that keeps states as values, and counts what is written and read."""

    def __init__(self):
        self.timers, self.elements, self.value, self.reads, self.writes = set(), [], None, 0, 0
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def get(self):
        raise NotImplementedError


class Elements(Handle):
    def get(self):
        self.reads += len(self.elements)
        return iter(self.elements)

    def appendValue(self, x):  # noqa: N802
        self.appendList([x])

    def appendList(self, x):  # noqa: N802
        self.writes += len(x)
        self.elements = [*self.elements, *x]

    def put(self, x):
        self.clear()
        self.appendList(x)

    def clear(self):
        self.elements = []


class Value(Handle):
    def get(self):
        return self.value


def test_requests_of_a_frame_are_one_element_of_state_that_is_read_once():
    """Elements of state and frames without rows cost seconds for each job, so they may not follow the requests."""

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10_000_000

    handle, waiting, job = Handle(), Elements(), Value()
    handle.getValueState, handle.getListState = lambda *a: job, lambda *a: waiting
    p = leases.Leases()
    p.init(handle)
    frame = lambda seqs: pd.DataFrame({"job": 1, "seq": seqs, "at": pd.to_datetime([s * 1_000_000 for s in seqs], unit="us"), "kind": ["enqueue" if s == 1 else "claim" for s in seqs], "worker": [None if s == 5 else 2 for s in seqs], "token": [None] * len(seqs)})
    assert not list(p.handleInputRows((1,), iter([frame(range(3, 500)), frame([20_000])]), Now()))
    assert not list(p.handleInputRows((1,), iter([frame([1, 2])]), Now()))
    assert waiting.writes == 3 and waiting.reads == 0 and handle.timers == {1000}
    handle.timers.clear()
    (out,) = p.handleExpiredTimer((1,), Now(), None)
    assert waiting.reads == 3 and handle.timers == {20_000_000} and len(waiting.elements) == 1
    assert out["seq"].tolist() == [*range(1, 302), -1, *range(302, 500), -1] and set(out["outcome"]) == {"queued", "granted", "wait", "expired"}
    assert pd.isna(out["worker"][4]) and out["worker"].drop(4).eq(2).all()
