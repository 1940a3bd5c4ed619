"""Hard negatives against plain inner products of all anchors and rows."""

import math
import random

import numpy as np
import pytest

from tests.oracle import connection, rows
from tidemark.llm import negatives, queries


def brute(data):
    e = {}
    for i, v, label in data:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        e[i] = min(e.get(i, own), own)
    out = set()
    for a, (la, va) in e.items():
        if a % 100:
            continue
        s = sorted(((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in e.items() if i != a))
        for ps, p, _ in [x for x in s if x[2] == la][:5]:
            band = [(ns, i) for ns, i, label in s if label != la and 30 * -ps <= 100 * -ns <= 90 * -ps][:10]
            out |= {(a, p, k + 1, i, -ps, -ns) for k, (ns, i) in enumerate(band)}
    return out


def data(n, dims, seed, step=1.0):
    r = random.Random(seed)
    hot = [r.uniform(-1, 1) for _ in range(dims)]
    out = []
    for i in range(n):
        v = list(hot) if r.random() < 0.3 else [round(r.uniform(-1, 1) / step) * step + h for h in hot]
        out.append((i, v, r.choice([0, 0, 0, 1, 2, 9])))
    return out


COLUMNS = "vec_id long, embedding array<double>, label int, v string, `a.b` int"


def mined(spark, rows_, parts=3):
    d = spark.createDataFrame([(*x, "clash", 1) for x in rows_], COLUMNS).repartition(parts)
    got = [tuple(x) for x in negatives.mine(d).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("dims", "step"), [(64, 1.0), (70, 0.01), (3, 0.5), (200, 0.25)])
def test_as_brute_force(spark, monkeypatch, dims, step):
    monkeypatch.setattr(negatives, "STEP", 50)
    monkeypatch.setattr(negatives, "PAIRS", 97)
    d = data(500, dims, dims, step)
    want = brute(d)
    assert want and mined(spark, d) == want


def test_blocks_of_anchors_give_the_same(spark, monkeypatch):
    d = data(900, 16, 4, 0.1)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    assert mined(spark, d) == brute(d)


def test_odd_rows(spark):
    d = data(300, 8, 1, 0.2)
    d += [(None, [1.0] * 8, 0), (400, None, 0), (401, [1.0] * 8, None), (402, [None] + [1.0] * 7, 0), (403, [float("nan")] * 8, 1), (500, [float("inf")] * 8, 1)]
    d += [(600, [], 0), (601, [1.0], 0), (700, [2.0] * 200, 1), (701, [2.0] * 20, 2), (702, [-0.4] * 90 + [2.0] * 110, 1), (-100, [1.0] * 8, 2), (-7, [0.5] * 8, -1), (800, [0.0] * 8, 5), (804, [0.0] * 8, 5), (803, [0.0] * 8, 6)]
    d += [(100, [9.0] * 8, 7), (100, [9.0] * 8, 7), (200, [0.1] * 8, 3), (7, [0.1] * 8, 3)]
    want = brute(d)
    assert {800, 700, -100} <= {x[0] for x in want} and mined(spark, d) == want
    assert mined(spark, d[:1][:0]) == set()
    assert mined(spark, [(100, [1.0], 1)]) == set()


def test_scores_beyond_doubles_are_exact(spark):
    r = random.Random(2)
    d = [(i, [r.randrange(-(1 << 21), 1 << 21) + r.random() for _ in range(6)], r.choice([1, 2])) for i in range(120)]
    assert max(x[4] for x in brute(d)) > 1 << 55
    assert mined(spark, d) == brute(d)


def test_bounds_hold_and_leave_out_most_of_clustered_vectors():
    r = np.random.default_rng(3)
    step = np.repeat(r.normal(size=(400, 16)), 4, axis=1) * 100
    v = np.floor(step + r.normal(size=step.shape) * 5).astype(np.int64)
    b = negatives.Block(np.arange(400), np.zeros(400), v)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(400)))
    s = negatives.products(b, b, i, j)
    assert (s == (v[i].astype(int) * v[j].astype(int)).sum(axis=1)).all()
    width = []
    for level in range(3):
        lo, hi = negatives.bounds(b, b, level, i, j)
        assert (lo <= s).all() and (s <= hi).all()
        width.append(float((hi - lo).mean()))
    assert width[0] > width[1] > width[2]
    least = np.sort(s.reshape(400, 400), axis=1)[:, -10].astype(float)
    x, y = negatives.survivors(b, b, np.ones((400, 400), bool), least, np.full(400, np.inf))
    kept = set(zip(x.tolist(), y.tolist()))
    assert {(a, c) for a, c, k in zip(i, j, s) if k >= least[c]} <= kept and len(kept) < 0.05 * 400 * 400


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(queries.QUERIES["op13_hard_negatives"](spark, sf).toPandas()) == rows(connection(sf).sql(negatives.SQL).df())
