import math
import random

import numpy as np
import pytest

from tidemark.operators import quantiles as Q


@pytest.mark.parametrize("kind", ["spread", "ties", "sorted", "tiny"])
def test_exact_percentiles_between_bounds(spark, monkeypatch, kind):
    monkeypatch.setattr(Q, "KEEP", 16)
    monkeypatch.setattr(Q, "COUNTED", 60)
    r = random.Random(kind)
    value = {"spread": lambda i: r.gauss(0, 100), "ties": lambda i: float(r.choice([1, 1, 1, 2, 3])), "sorted": float, "tiny": lambda i: float(i)}[kind]
    n = 6000 if kind != "tiny" else 7
    data = [(r.choice(["a", "a", "a", "b", None]), value(i)) for i in range(n)] + [("c", 5.0), ("d", None), ("a", None)]
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {(x.g, x.share): (x.disc, x.cont) for x in Q.percentile_exact(spark.createDataFrame(data, "g string, v double").repartition(5), ["g"], "v", shares).collect()}
    want = {}
    for g in {a for a, v in data if v is not None}:
        v = sorted(x for a, x in data if a == g and x is not None)
        for s in shares:
            pos = round(s * (len(v) - 1), 6)
            lo, hi = v[math.floor(pos)], v[math.ceil(pos)]
            want[g, s] = (v[max(1, math.ceil(round(s * len(v), 6))) - 1], lo + (hi - lo) * (pos - math.floor(pos)))
    assert got.keys() == want.keys() and ("d", 0.5) not in got
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_a_sketch_is_small_and_its_ranks_are_within_its_error(monkeypatch):
    monkeypatch.setattr(Q, "KEEP", 64)
    v = np.random.default_rng(1).permutation(100_000).astype(float)
    s = Q.Sketch()
    for part in np.array_split(v, 37):
        s.add(part)
    x, w = s.items()
    assert w.sum() == s.n == len(v) and len(x) < 2 * 64 * 14
    order = np.argsort(x)
    off = np.cumsum(w[order]) - (x[order] + 1)  # a value's rank is itself plus one
    assert np.abs(off).max() <= s.err < 0.2 * len(v)
