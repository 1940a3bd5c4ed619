from tidemark.operators import curation as C


def test_relations_take_every_branch(spark):
    pairs = [
        (1, "port 80 is open", "port 81 is open"),
        (2, "the same text", "the same text"),
        (3, "the cache holds 5 rows for each user", "the cache holds rows"),
        (4, "the cache holds rows", "the cache holds"),
        (5, "something else", "the cache holds"),
    ]
    got = {r.id: (r.relation, r.tier) for r in C.relations(spark.createDataFrame(pairs, "id int, new string, old string"), ["id"]).collect()}
    assert got == {1: ("dropped", "none"), 2: ("duplicate", "auto"), 3: ("refines", "question"), 4: ("relates", "question"), 5: ("relates", "ledger")}


def test_stages_are_taken_up_again(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    for made in (["a"], []):
        run = C.Stages(spark, folder)
        assert run.stage("a", lambda: spark.range(3)).count() == 3 and run.made == made


def test_declarations_skip_fences_quotes_and_denials(spark):
    body = "Supersedes docs/a.md, b.md\n```\nreplaces docs/c.md\n```\n> ersetzt docs/d.md\nit never replaces docs/e.md\n```\nreplaces docs/f.md"
    items = spark.createDataFrame([(1, "x.md", body), (2, None, None), (3, "y.md", "")], "key int, path string, body string")
    assert sorted((r.key, r.target.value) for r in C.declarations(items).collect()) == [(1, "b.md"), (1, "docs/a.md")]
