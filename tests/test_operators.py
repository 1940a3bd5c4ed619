import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions import text as X
from tidemark.operators import evaluation as E
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.operators import temporal as T

D = lambda n: dt.datetime(2020, 1, n)


def test_overlap_is_half_open(spark):
    d = spark.createDataFrame([(1, 5, 5, 9), (1, 5, 4, 9), (1, None, 100, None), (3, 4, 1, 2)], "a int, b int, c int, d int")
    got = [r.o for r in d.select(P.overlaps((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).alias("o")).collect()]
    assert got == [False, True, True, False]


def test_survivors(spark):
    d = spark.createDataFrame([(1, D(1), D(9)), (2, D(4), D(5)), (3, D(5), None), (4, D(1), D(2))], "version_id int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    lit = lambda n: F.lit(D(n)).cast("timestamp_ntz")
    got = sorted((r.version_id, r.valid_from.day, r.valid_to and r.valid_to.day) for r in T.survivors(d, lit(3), lit(6)).collect())
    assert got == [(1, 1, 3), (1, 6, 9), (3, 6, None), (4, 1, 2)]


def test_glob(spark):
    d = spark.createDataFrame([("src/a.py",), ("src/b/c.py",), ("x.md",)], "p string")
    assert [r.g for r in d.select(P.glob(F.col("p"), ["src/*.py"]).alias("g")).collect()] == [True, False, False]
    assert [r.g for r in d.select(P.glob(F.col("p"), ["src/**"]).alias("g")).collect()] == [True, True, False]


def test_mcnemar(spark):
    d = spark.createDataFrame([(0, 0), (5, 0), (1, 9), (6, 6)], "b long, c long")
    got = [round(r.p, 6) for r in d.select(E.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    assert got == [1.0, 0.0625, 0.021484, 1.0]


def test_reach_ends_on_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "src long, dst long")
    got = {r.node: r.depth for r in G.reach(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {(r.src, r.dst) for r in G.cycle_edges(e).collect()} == {(1, 2), (2, 3), (3, 1)}


def test_chains(spark):
    p = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 12)], "node long, parent long")
    assert sorted((r.node, r.ancestor, r.depth) for r in G.chains(p).collect()) == sorted((i, j, i - j) for i in range(1, 12) for j in range(1, i))


def test_pack_prefix_stops_at_the_first_that_does_not_fit(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 1)], "g string, o int, n int")
    assert [r.o for r in R.pack_prefix(d, ["g"], [F.col("o")], "n", 10).collect()] == [1]


def test_fold():
    assert X.fold("ÉCOLE Straße İı") == X.fold(X.fold("ÉCOLE Straße İı"))
    assert X.fold("Élan") == "elan" and X.fold(None) is None


def test_masks(spark):
    d = spark.createDataFrame([("mail me at a.b@c.org from 10.0.0.1, password: hunter2",)], "t string")
    r = d.select(X.mask(F.col("t")).alias("m"), X.findings(F.col("t")).alias("f")).first()
    assert r.m == "mail me at [email] from [ipv4], [assignment]" and r.f == ["assignment", "email", "ipv4"]


def test_cycle_edges_and_levels_against_brute_force(spark):
    import random

    r = random.Random(5)
    n, m = 12, 18
    e = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    paths = set(e)
    for k in range(n):
        paths |= {(a, b) for a in range(n) for b in range(n) if (a, k) in paths and (k, b) in paths}
    d = spark.createDataFrame([*e, *list(e)[:3], (None, 1), (2, None)], "src long, dst long")
    got = [(x.src, x.dst) for x in G.cycle_edges(d).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in e if (b, a) in paths or a == b}
    behind = {b for a, b in paths if (a, a) in paths}
    longest = {v: 0 for x in e for v in x}
    for _ in range(n):
        for a, b in e:
            if b not in behind:
                longest[b] = max(longest[b], longest[a] + 1)
    assert {x.item: x.round for x in G.levels(d).collect()} == {v: None if v in behind else k for v, k in longest.items()}
    none = spark.createDataFrame([], "src long, dst long")
    assert G.cycle_edges(none).count() == 0 and G.levels(none).count() == 0


def test_running_over_many_ranges_and_one_hot_group(spark, monkeypatch):
    import random

    from tidemark.operators import ranks

    r = random.Random(3)
    data = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(9)) for i in range(600)] + [("c", 1, None)]
    d = spark.createDataFrame(data, "g string, i long, n int")
    monkeypatch.setattr(ranks, "RANGE_ROWS", 40)
    for most in (None, 300):
        want = set()
        for g in {x[0] for x in data}:
            own, used = sorted((x for x in data if x[0] == g), key=lambda x: -x[1]), 0
            for k, (_, i, n) in enumerate(own, 1):
                used += n or 0
                if most is None or used <= most:
                    want.add((g, i, k, len(own), used))
        got = [(x.g, x.i, x.row_no, x.total, x.used) for x in ranks.running(d, ["g"], [F.col("i").desc()], F.col("n"), most).collect()]
        assert len(got) == len(want) and set(got) == want
    assert ranks.running(d.limit(0), ["g"], [F.col("i")]).count() == 0


def test_cycle_edges_jobs_follow_the_rounds_and_not_both_ways(spark):
    """A round is one write; what it came to is seen meanwhile. A ring and its chord of n nodes take n rounds one way, and the other way goes along."""
    n = 8
    rows = [(i, (i + 1) % n) for i in range(n)] + [(3, 1), (20, 21), (21, 22), (5, 20), (30, 31), (31, 30), (2, 30)]
    e = spark.createDataFrame(rows, "src long, dst long")
    sc = spark.sparkContext
    sc.setJobGroup("cycles", "cycles")
    got = {tuple(x) for x in G.cycle_edges(e).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("cycles"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == set(rows) - {(20, 21), (21, 22), (5, 20), (2, 30)}
    assert jobs < 128  # 145 where the ways were gone one after the other, and counted by jobs of their own
