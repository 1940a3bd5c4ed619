import pytest

from tests.oracle import connection, rows
from tidemark.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    registry.queries()[name](spark, sf).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_of_a_very_long_document_stay_its_own(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.plans import retrieval
    from tidemark.sources.tables import table

    tail = " ".join(["apple"] * 40)
    table(spark, sf, "benchmark").limit(0).unionByName(spark.createDataFrame([(20, "apple pear")], "item_id long, text string"), allowMissingColumns=True).write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, sf, "embeddings").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(1, " ".join(["filler"] * 36_000) + " " + tail), (2, "apple and pear")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    c = retrieval.chunks(spark, d).where(F.exists("words", lambda x: x == "apple")).collect()
    places = {(x.doc_id, x.chunk_id): 0.1 * sum(w in ("apple", "pear") for w in x.words) for x in c}
    want = {k: round(r / (r + 1), 6) for k, r in places.items()}
    assert {k for k, _ in want} == {1, 2} and len({k for _, k in want}) < len(want)
    got = retrieval.lexical_top(spark, d).collect()
    assert sorted((x.chunk_id, x.score) for x in got) == sorted((k, s) for (_, k), s in want.items())
    lexicon = retrieval.Lexicon(spark, d)
    assert {(x.doc_id, x.chunk_id) for x in retrieval.fused(lexicon).collect()} == set(want)
    seen = spark.createDataFrame([(2,)], "doc_id long")
    assert {x.doc_id for x in retrieval.fused(lexicon, seen).collect()} == {2}


@pytest.mark.parametrize("most", [100_000, 20])
def test_collapse_of_one_user_over_many_ranges(spark, monkeypatch, most):
    import random

    from tidemark.plans import windows

    monkeypatch.setattr(windows, "RANGE_ROWS", most)
    r = random.Random(11)
    data = [(u, i, float(v)) for u in (1, 2, None) for i in r.sample(range(300), 220) for v in [r.choice([r.randrange(5), i])]]
    data += [(7, i, float(i)) for i in range(400)] + [(7, 5, 1000.0), (8, None, 1.0), (8, 1, None), (8, 2, 9.0), (8, 3, 9.0)]
    want = set()
    for u in {x[0] for x in data}:
        kept = []
        for _, i, v in sorted((x for x in data if x[0] == u), key=lambda x: (x[2] is not None, -(x[2] or 0), x[1] is not None, x[1] or 0)):
            if i is None or all(k is None or abs(k - i) > 1 for k in kept):
                kept.append(i)
        want |= {(u, p, i) for p, i in enumerate(kept)}
    out = windows.collapse(spark.createDataFrame(data, "user_id long, event_id long, value double")).collect()
    got = [tuple(x) for x in out]
    assert len(got) == len(set(got)) and set(got) == want
