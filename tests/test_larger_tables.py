"""Rows that only larger tables have, held against the SQL of their queries."""

import duckdb
import pytest

from tests.oracle import rows
from tidemark.plans import registry


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Whether a query gives the rows of its SQL over tables {name: (rows, schema)}."""

    def held(name, **tables):
        duck = duckdb.connect()
        duck.execute("SET TimeZone = 'UTC'")
        for t, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{t}.parquet")
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = rows(duck.sql(registry.oracle_sql()[name]).df())
        assert want and rows(registry.queries()[name](spark, str(tmp_path)).toPandas()) == want
        return want

    return held


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_declared_rows_stay_apart_beyond_nine_thousand_documents(same_as_sql):
    same_as_sql("declarations", documents=([(i, "a", "en", "s", 1) for i in (*range(13), *range(8997, 9013), *range(99_996, 100_010))], DOCUMENTS))


@pytest.mark.parametrize("before", ["ab cd e", "ab cd ef", "ab cd efg", "a b c d e 7"])
def test_guards_of_a_turn_cut_within_a_word(same_as_sql, before):
    same_as_sql("relation_guards", conversations=([(1, t, "user", before) for t in range(11)], "conv_id long, turn int, role string, text string"))


def test_import_keeps_long_sections_whole_and_the_copy_the_sql_keeps(same_as_sql):
    long = "\n".join(["word " * 20] * 900)
    docs = [(94, "same text", "fr", "s", 9), (694, "same text", "fr", "s", 9), (3673, "same text", "fr", "s", 9), (1, long, "en", "s", 1), (2, long + "x", "fr", "s", 1), (3, long, "de", "s", 1)]
    got = same_as_sql("corpus_import", documents=(docs, DOCUMENTS))
    assert sum("copy-of:fr/3673.md" in r for r in got) == 2


def test_runs_are_told_apart_over_all_events(same_as_sql):
    kinds = [(1, "view", 5.0), (1, "click", 500.0), (2, "view", 1.0), (3, "click", None), (4, "view", 300.0), (4, "click", 201.0), (5, "error", 300.0)]
    got = same_as_sql("set_diff_runs", events=(kinds, "user_id long, event_type string, value double"))
    assert len(got) == 4


def test_names_have_their_letter_test(same_as_sql):
    got = same_as_sql("account_naming", customer=([(1, "Müşteri#1"), (2, "Customer#2"), (3, "none"), (4, None)], "c_custkey long, c_name string"))
    assert sum("True" in r for r in got) == 1


def test_exported_files_are_many_to_a_task_and_to_no_single_folder(spark, same_as_sql, tmp_path):
    docs = [(i, None if i == 7 else f"text {i}", "en", "A Source", 9) for i in range(1500)]
    assert len(same_as_sql("export_tree", documents=(docs, DOCUMENTS))) == 1500
    read = registry.queries()["export_tree"](spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert len({f.rpartition("/")[0] for f in read.inputFiles()}) > 100
