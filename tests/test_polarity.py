"""Claims and quotes with expectations written by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import polarity as L

CASES = [
    ("the gate is enabled by default", "The gate is not enabled by default.", "dropped"),
    ("the gate is not enabled", "The gate isn't enabled yet.", "kept"),
    ("the cache never expires entries", "The cache expires entries.", "inserted"),
    ("backups run weekly", "Backups might run weekly.", "hardened"),
    ("backups may run weekly", "Backups run weekly.", "kept"),
    ("backups may run weekly", "Backups could run weekly.", "kept"),
    ("the index is rebuilt. Nothing is not logged", "The index is not rebuilt.", "dropped"),
    ("the index is rebuilt nightly", "The index is rebuilt nightly, not the archive.", "kept"),
    ("the archive is rebuilt", "The index is rebuilt but no archive.", "dropped"),
    ("the build uses locks", "The build is lock-free.", "dropped"),
    ("the build has no locks", "The build is lock-free.", "kept"),
    ("exports enabled streams", "Exports never enable streams.", "dropped"),
    ("das Archiv wird kopiert", "Das Archiv wird nicht kopiert.", "dropped"),
    (None, "Nothing is not logged.", "kept"),
    ("a claim", None, "kept"),
    ("", "", "kept"),
    ("yes. " * 5_000 + "the gate is enabled", "the gate is not enabled", "dropped"),
]


def test_polarity(spark):
    t = spark.createDataFrame([(i, c, q, "x") for i, (c, q, _) in enumerate(CASES)], "i long, claim string, quote string, polarity string")
    got = {x.i: x.polarity for x in L.judged(t, "claim", "quote").collect()}
    want = {i: x for i, (*_, x) in enumerate(CASES)}
    assert got == want


@pytest.mark.parametrize("claim, quote, named, missing", [
    ("Gate G-3 closes after NATO and Alice agree, says notes.md.", "g-3: alice", ["G-3", "NATO", "Alice", "notes.md"], ["NATO", "notes.md"]),
    ("Plain words. Sentence starts don't count", "", [], []),
    ("See: Berlin or (Paris), D12", "Paris", ["Paris", "D12"], ["D12"]),
    (None, None, [], []),
])
def test_subjects(spark, claim, quote, named, missing):
    t = spark.createDataFrame([(claim, quote)], "c string, q string")
    x = t.select(L.subjects(F.col("c")).alias("a"), L.unattributed(F.col("c"), F.col("q")).alias("b")).first()
    assert (x.a, x.b) == (named, missing)
