import corpus_pipeline


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == columns
        m = out.count()
        assert 0 < m <= n
        docs, n = spark.createDataFrame(out.toPandas(), out.schema), m
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    ran = corpus_pipeline.run(spark, sf).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, last[key].to_numpy().tolist())) == sorted(map(tuple, ran[key].to_numpy().tolist()))
    assert set(last.doc_id) == {r.doc_id for r in docs.collect()}


CLASH = ["key", "id", "row", "fp", "node", "root", "h", "w", "__row", "__key", "words", "item", "pairs", "exact", "near", "line_no", "component_id", "a.b"]


def test_stages_on_odd_rows_and_clashing_columns(spark, sf):
    good = "The report of the year is for all who read it at home and in the office.\nIt was written by the people who know what they want to say to the others."
    other = "A second text about the sea and the boats that go out for fish in the early morning light.\nNobody in the village knows when they come back from there."
    long = "\n".join(" ".join(f"word{i}x{k}" for k in range(15)) + " the and of to" for i in range(3000))
    rows = [(1, good), (1, good), (2, good), (3, other), (4, None), (5, ""), (6, " \n\n "), (None, other), (None, None), (7, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(CLASH))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH))
    want = {
        "quality_rules": [1, 1, 2, 3, 7, None],
        "line_dedup": [1, 1, 4, 5, 6, 7, None, None],  # doc 3 repeats the row without an id, which comes first
        "near_dedup": [1, 3, 4, 7, None, None],
        "decontamination": [1, 1, 2, 3, 4, 5, 6, 7, None, None],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted((x.doc_id for x in got), key=lambda x: (x is None, x)) == want[name], name
        assert all([x[c] for c in CLASH] == list(range(len(CLASH))) for x in got)
        assert not stage(spark, docs.limit(0), sf).collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert len(packed[packed.start == 0]) == len(rows) and packed.groupby("sequence_id").length.sum().max() <= 4096
    assert not corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).collect()
