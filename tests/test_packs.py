import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import corpora
from tidemark.sources import bucketed, packs


@pytest.fixture
def folder(tmp_path):
    for pack, n in (("a", 50), ("b", 3), ("c", 0)):
        lines = [json.dumps({"id": i, "tier": None if i % 2 else "t1", "x": "é" * (i % 7), "gold": "own" if i % 3 == 0 else None, "vector": [[1.0, i], [1.0], None, [1, "nan"]][i % 4]}, ensure_ascii=False) for i in range(n)]
        (tmp_path / f"{pack}.jsonl").write_text("\n".join(lines) + ("\n\n" if pack == "b" else ""))
    (tmp_path / "note.txt").write_text("no pack")
    return str(tmp_path)


def pushed(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("split", [1 << 20, 64, 7])
def test_all_cases_once_whatever_the_split(spark, folder, monkeypatch, split):
    reader = packs.PackReader(folder)
    monkeypatch.setattr(packs, "SPLIT", split)
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted((r[0], int(r[1])) for r in got) == [("a", i) for i in range(50)] + [("b", i) for i in range(3)]
    assert json.loads(got[1][3])["x"] == "é"


def test_a_filter_on_packs_is_pushed_down(spark, folder):
    assert packs.packs(spark, folder).count() == 53
    d = packs.packs(spark, folder).where("pack = 'b' AND case_id <> '1'")
    assert sorted(r.case_id for r in d.collect()) == ["0", "2"] and packs.packs(spark, folder).where("pack IN ('b', 'c')").count() == 3
    reader = packs.PackReader(folder)
    left = list(reader.pushFilters([packs.EqualTo(("pack",), "b"), packs.EqualTo(("tier",), "t1"), packs.In(("pack",), ("a", "b"))]))
    assert left == [packs.EqualTo(("tier",), "t1")] and {p.pack for p in reader.partitions()} == {"b"}
    assert d.rdd.getNumPartitions() == 1 and "pack = b" not in pushed(d) and "case_id" in pushed(d)


def test_gold_overlay_and_vectors(spark, folder):
    gold = spark.createDataFrame([("b", "0", "laid over"), ("b", "1", "laid over"), ("a", "9", "laid over")], "pack string, case_id string, gold string")
    got = {(r.pack, r.case_id): (r.gold, r.gold_from) for r in packs.with_gold(packs.packs(spark, folder), gold).collect()}
    assert got["b", "0"] == got["a", "9"] == ("laid over", "overlay") and got["a", "3"] == ("own", "case") and got["b", "2"] == (None, "none") and len(got) == 53
    v = {r.case_id: (r.vector, r.reason) for r in packs.vectors(packs.packs(spark, folder).where("pack = 'a'"), 2).collect()}
    assert v["4"] == ([1.0, 4.0], None) and v["1"] == (None, "other-length") and v["2"] == (None, "no-vector") and v["3"][0] is None


def test_buckets_are_not_shuffled_again(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 97).alias("logical_id"), F.col("id").alias("version_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("valid_from"), F.rand(3).alias("weight"))
    kept = bucketed.bucketed(rows, "logical_id", ["valid_from", "version_id"], f"file://{tmp_path}", buckets=4)
    owners = spark.range(100).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_mktsegment"))
    d = corpora.history(kept, owners)
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SelectedBucketsCount: 4 out of 4" in plan and "hashpartitioning(logical_id" not in plan and plan.count("Exchange hashpartitioning(c_custkey") <= 1
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, corpora.history(rows, owners).collect()))
