"""Places of terms are looked up where the chunks lie."""

from tidemark.operators import lexicon as L


def test_index_and_hits_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(L, "held", lambda d, *_: d)
    chunks = spark.createDataFrame([(i, i * 1000, ["ab", "b", "Ab", "x"][: 1 + i % 4]) for i in range(20)], "doc_id long, chunk_id long, words array<string>")
    idx = L.index(chunks)
    expanded = spark.createDataFrame([(q, t, 1, t, t) for q in (1, 2) for t in ("ab", "x")], "qid long, grp string, m int, term string, tok string")
    for rows in (idx, L.cover_density(idx, expanded)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, i * 1000, ["ab", "b", "Ab", "x"][: 1 + i % 4]) for i in range(20)], "doc_id long, chunk_id long, words array<string>")
    idx = L.index(chunks)
    terms = spark.createDataFrame([(q, t) for q in range(9) for t in ("ab", "x")[: 1 + q % 2]], "qid long, term string")
    found = lambda: sorted(map(tuple, L.cover_density(idx, L.expand(L.vocabulary(idx), L.any_of(terms))).collect()))
    want = found()
    monkeypatch.setattr(L, "ENTRIES", 3)
    assert want and found() == want


def test_no_pair_of_word_and_term_is_shuffled(spark, monkeypatch):
    words = spark.createDataFrame([(w, [w[i : i + 2] for i in range(len(w) - 1)]) for w in ("abcd", "abce", "xyz", "bcda")], "word string, t array<string>")
    terms = words.where("word <> 'abce'").withColumnRenamed("word", "term")
    for block, step in ((2000, 512), (1, 2)):
        monkeypatch.setattr(L, "TERMS", block)
        monkeypatch.setattr(L, "STEP", step)
        d = L.sharing(words, terms, 0.6)
        assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, d.collect())) == [("abcd", "abcd", 3, 3), ("abcd", "abce", 2, 3), ("abcd", "bcda", 2, 3), ("bcda", "abcd", 2, 3), ("bcda", "bcda", 3, 3), ("xyz", "xyz", 2, 2)]
