"""Queries that are asked all items of the benchmark, with all their words."""

import pyarrow.parquet as pq

from tests.oracle import connection, rows
from tidemark.plans import registry
from tidemark.sources.tables import TABLES, table


def small(spark, sf, folder, items, docs):
    """A folder with these items and documents; the other tables are those of ``sf`` without rows."""
    own = {"benchmark": spark.createDataFrame(items, "item_id long, text string"), "documents": spark.createDataFrame(docs, "doc_id long, text string")}
    for name in TABLES:
        pq.write_table(own.get(name, table(spark, sf, name).limit(0)).toArrow(), f"{folder}/{name}.parquet")
    return str(folder)


def same_as_sql(spark, d, name):
    got = registry.queries()[name](spark, d).toPandas()
    assert rows(got) == rows(connection(d).sql(registry.oracle_sql()[name]).df())
    return got


def test_short_words_are_matched_too(spark, sf, tmp_path):
    d = small(spark, sf, tmp_path, [(1, "cat"), (2, "a notebook")], [(1, "Cats and notebooks"), (2, "a cat"), (3, None)])
    got = same_as_sql(spark, d, "word_similarity_match")
    assert {("cat", "cats"), ("cat", "cat"), ("a", "a"), ("notebook", "notebooks")} <= set(zip(got["term"], got["word"], strict=True))


def test_all_items_are_queries(spark, sf, tmp_path):
    d = small(spark, sf, tmp_path, [(1, "notebooks of apple_pie"), (20, "lighthouse")], [(1, "old notebooks and apple_pie"), (2, "the lighthouse")])
    for name in ("trigram_top", "rrf_fusion"):
        assert set(same_as_sql(spark, d, name)["qid"]) == {1, 20}
