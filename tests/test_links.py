"""Bulk links and revised links on small fixtures, against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import links as L

DAY = dt.datetime(2020, 1, 1)
day = lambda n: None if n is None else DAY + dt.timedelta(days=n)


def test_outcomes_apply_and_revert(spark):
    p = [
        (1, 1, 2, 10, 20, 0.9, "proposed"), (2, 1, 2, 10, 20, 0.9, "proposed"), (3, 1, 2, 10, 20, 0.95, "rejected"), (4, 3, 3, 30, 30, 0.9, "proposed"), (5, None, 3, 0, 30, 0.9, "proposed"),
        (6, 3, 4, 30, 40, 0.4, "proposed"), (7, 3, 4, 30, 40, None, "proposed"), (8, 5, 6, 50, 60, 0.9, "proposed"), (9, 6, 5, 60, 50, 0.9, "proposed"),
        (10, 7, 8, 70, 80, 0.9, "proposed"), (11, 8, 9, 80, 90, 0.9, "proposed"), (12, 9, 7, 90, 70, 0.9, "proposed"), (13, 9, 10, 90, 100, 0.9, "proposed"),
        (14, 10, 11, 100, 110, 0.9, "proposed"), (15, 12, 11, 120, 110, 0.9, "proposed"), (16, 13, 14, 130, 140, 0.9, "proposed"), (17, 2, 13, 20, 130, 0.9, "proposed"), (18, 2, 99, 20, 990, 0.9, "proposed"), (19, 1, 3, 10, 30, 0.9, None),
    ]
    live = [(11, 10), (12, 11), (14, 15), (15, 13), (None, 4)]
    heads = [(i, i * 10 + (i == 13), day(i)) for i in range(1, 16)]
    shape = "id long, src long, dst long, src_version long, dst_version long, confidence double, status string"
    table = lambda rows, s: spark.createDataFrame(rows, s)
    live, heads = table(live, "src long, dst long"), table(heads, "item long, version long, valid_from timestamp_ntz")
    judged = L.judge(table(p, shape), live, heads, 0.5)
    got = {x.id: (x.outcome, x.valid_from) for x in judged.collect()}
    want = {1: "applied", 2: "duplicate", 3: "not-proposed", 4: "self", 5: "no-endpoint", 6: "low", 7: "low", 8: "both-directions", 9: "both-directions", 10: "cycle", 11: "cycle", 12: "cycle"}
    want |= {13: "applied", 14: "linked", 15: "linked", 16: "live-cycle", 17: "stale", 18: "stale", 19: "not-proposed"}
    assert {k: v[0] for k, v in got.items()} == want
    assert {k: v[1] for k, v in got.items() if v[1]} == {1: day(2), 13: day(10)}
    at, later = (F.lit(str(day(n))).cast("timestamp_ntz") for n in (100, 200))
    rows = [(500, 1, 9, "bulk", day(0), day(0), day(1)), (501, 2, 9, "hand", day(0), day(0), None)]
    links = table(rows, "link_id long, src long, dst long, origin string, valid_from timestamp_ntz, recorded_at timestamp_ntz, superseded_at timestamp_ntz")
    after = L.applied(links, judged, "bulk", at)
    assert {x.link_id: x.superseded_at for x in after.collect()} == {500: day(1), 501: None, 1: None, 13: None}
    undone = L.reverted(after, "bulk", later)
    assert {x.link_id: x.superseded_at for x in undone.collect()} == {500: day(1), 501: None, 1: day(200), 13: day(200)}
    assert sorted(map(str, L.reverted(undone, "bulk", at).collect())) == sorted(map(str, undone.collect()))
    assert not L.judge(table([], shape), live, heads).collect()


def test_revised_as_day_by_day(spark):
    r = random.Random(3)
    links = [(i, r.randrange(4), i % 7, (a := r.randrange(40)), a + r.randrange(1, 30) if r.random() < 0.8 else None, r.choice([None, None, 50])) for i in range(40)]
    fixes = [(s, (a := r.randrange(60)), r.choice([a, a + 3, a + 12, None])) for s in (0, 0, 0, 1, 1, 2)] + [(0, None, 5), (2, 4, 4), (None, 1, 2)]
    fixes += [fixes[0]]
    targets = [(0, 70), (1, 70), (1, 71), (1, 71), (3, 70)]
    ts = "timestamp_ntz"
    t = spark.createDataFrame([(i, s, d, day(a), day(b), day(0), day(e)) for i, s, d, a, b, e in links], f"link_id long, src long, dst long, valid_from {ts}, valid_to {ts}, recorded_at {ts}, superseded_at {ts}")
    f = spark.createDataFrame([(s, day(a), day(b)) for s, a, b in fixes], f"src long, fix_from {ts}, fix_to {ts}")
    at = F.lit(str(day(300))).cast(ts)
    got = L.revised(t, f, spark.createDataFrame(targets, "src long, dst long"), at).collect()
    far = 500
    real = {(s, a, far if b is None else b) for s, a, b in fixes if s is not None and a is not None and (b is None or a < b)}
    want = {(None, s, d, day(a), None if b == far else day(b), "inserted", None) for s, a, b in real for x, d in targets if x == s}
    for i, s, d, a, b, e in links:
        days = range(a, far if b is None else b)
        fixed = {n for x, y, z in real if x == s for n in range(y, z)}
        hit = e is None and any(n in fixed for n in days)
        want.add((i, s, d, day(a), day(b), "closed" if hit else "kept", day(300) if hit else day(e)))
        left = [n for n in days if n not in fixed] if hit else []
        for n in left:
            if n - 1 not in left:
                stop = next(m for m in range(n, far + 1) if m not in left)
                want.add((i, s, d, day(n), None if stop == far else day(stop), "survivor", None))
    rows = [(x.link_id, x.src, x.dst, x.valid_from, x.valid_to, x.op, x.superseded_at) for x in got]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {x[5] for x in want} == {"kept", "closed", "survivor", "inserted"}
