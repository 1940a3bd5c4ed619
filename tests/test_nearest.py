"""Nearest vectors against the plain definition, over copies, ties, missing vectors and several blocks."""

import math
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest

from tidemark.operators import retrieval as R


def plain(queries, vectors, k):
    out = []
    for q, qv in queries:
        found = []
        for v, x in vectors:
            if v == q or v is None:
                continue
            ok = qv and x and len(x) == len(qv) and None not in x and None not in qv
            s = sum((a * b for a, b in zip(qv, x, strict=True)), 0.0) if ok else None
            sim = None if s is None else float(Decimal(repr(s)).quantize(Decimal("1e-4"), ROUND_HALF_UP))
            found.append((sim is None, -(sim or 0.0), v, sim))
        out += [(q, v, sim, n + 1) for n, (_, _, v, sim) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "step", "rows"), [(20_000, 2048, 16_384), (7, 5, 40)])
def test_nearest_is_exact(spark, monkeypatch, block, step, rows):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "STEP", step)
    monkeypatch.setattr(R, "TASK_ROWS", rows)
    r = random.Random(3)
    seeds = [[r.choice([r.uniform(-1, 1), 0.5, 0.25]) for _ in range(6)] for _ in range(12)]
    near = lambda: [x + r.choice([0.0, 1e-5, 3e-5, 5e-5]) for x in r.choice(seeds)]
    vectors = [(i, seeds[0]) for i in range(60)] + [(i, near()) for i in range(60, 170)] + [(171, None), (172, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (173, [1.0]), (None, seeds[1])]
    queries = [x for x in vectors if x[0] is not None and x[0] % 9 == 0] + [(500, None), (172, vectors[-3][1]), (501, [0.1] * 6)]
    q = spark.createDataFrame(queries, "q long, qv array<double>")
    e = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for k in (4, 172):
        got = sorted((tuple(x) for x in R.cosine_top(q, e, k).select("q", "v", "sim", "rank").collect()), key=str)
        assert got == plain(queries, vectors, k)


def test_no_row_of_the_plan_is_a_pair(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "q long, qv array<double>")
    e = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    plan = R.cosine_top(q, e, 2)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoopJoin|CartesianProduct", plan)
