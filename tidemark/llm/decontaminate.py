"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.small import sized
from tidemark.llm.text import let, tokens, windows
from tidemark.session import cut

SHINGLE, CONTAINMENT = 5, 0.8


def _hashes(text: str) -> Column:
    return F.transform(tokens(F.col(text)), lambda x: F.xxhash64(x))


def sketches(bench: DataFrame, id_col: str = "item_id", text: str = "text", share: float = CONTAINMENT) -> DataFrame:
    """The items: (item_id, words, n, need, part, h, sketch).

    Shingles are runs of SHINGLE lower-cased runs of letters and digits; an item of fewer words is one shingle of all its ``words``.
    An item of n different shingles is contained if ``need`` = ceil(share * n) of them are. Its sketch is its n - need + 1
    smallest hashes (a bottom MinHash sketch): a text that holds ``need`` shingles misses n - need at most, so it holds one of the sketch.
    ``part`` is the size partition: items whose n has the same power of two.
    """
    w = bench.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), _hashes(text).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("words", F.least(F.size("w"), F.lit(SHINGLE)))
    short = F.coalesce(*(F.when(F.col("words") == k, windows(F.col("w"), k)) for k in range(1, SHINGLE + 1)))
    s = w.select("item_id", "words", F.array_sort(F.array_distinct(short)).alias("h"))
    s = s.withColumn("n", F.size("h")).withColumn("need", F.ceil(F.col("n") * F.lit(share) - 1e-9).cast("int"))
    return s.select("item_id", "words", "n", "need", F.floor(F.log2("n")).cast("int").alias("part"), "h", F.slice("h", F.lit(1), F.col("n") - F.col("need") + 1).alias("sketch"))


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): every pair with at least ``share`` of the item's shingles in the text.

    Each size partition is an index of its own, keyed by partition and sketch hash. A text asks those whose least need it can meet, with the hashes
    that are not above the partition's largest one; what it finds is verified by exact containment. Texts and items without a word match nothing; null
    texts are empty; rows with a null id are left out (they can't be named). Items that share an item_id are each searched and the best
    counts; repeated documents give one row. Texts are asked for whole, whatever their length. Items without number or size limit: their sketches
    are broadcast only below a checked size, else both sides are shuffled by key.
    """
    items = cut(sketches(bench, item_col, item_text, share).withColumn("item", F.xxhash64("item_id", "h")).dropDuplicates(["item"]))
    by_words = {r["words"]: r["n"] for r in items.groupBy("words").agg(F.sum("n").alias("n")).collect()}  # SHINGLE rows at most
    total = sum(by_words.values())
    keys = items.select(F.explode("sketch").alias("key"), "item", "part")
    # a row for each power of two: what a text must have to be asked for it
    parts = [tuple(r) for r in items.groupBy("part").agg(F.min("need"), F.max(F.array_max("sketch"))).orderBy("part").collect()]
    sizes = sorted(by_words) or [SHINGLE]

    def shingles(rows: DataFrame) -> DataFrame:
        of = lambda w: F.concat(*(windows(w, k) for k in sizes))
        return rows.select(F.col(id_col).alias("doc_id"), let(_hashes(text), of).alias("h"))

    asks = lambda x, n: F.filter(F.array(*(F.when((n >= need) & (x <= top), F.lit(part)) for part, need, top in parts)), lambda p: p.isNotNull())
    top = max((t for _, _, t in parts), default=0)
    d = shingles(docs.where(F.col(id_col).isNotNull()))
    probe = d.select("doc_id", F.size("h").alias("n_h"), F.explode("h").alias("key")).where(F.col("key") <= top)
    probe = probe.select("doc_id", "key", F.explode(asks(F.col("key"), F.col("n_h"))).alias("part")) if parts else probe.select("doc_id", "key", F.lit(0).alias("part")).where("false")
    hits = probe.join(sized(keys, total), ["part", "key"])
    pairs = cut(hits.select("doc_id", "item").distinct())
    n_docs = pairs.select("doc_id").distinct().count()
    chosen = docs.join(sized(pairs.select(F.col("doc_id").alias(id_col)).distinct(), n_docs, 16), id_col, "left_semi")
    held = shingles(chosen).select("doc_id", F.explode(F.array_distinct("h")).alias("key"))
    whole = items.select("item", "item_id", "n", "need", F.explode("h").alias("key"))
    found = held.join(sized(whole, total), "key").join(pairs, ["doc_id", "item"], "left_semi")
    found = found.groupBy("doc_id", "item_id", "item", "n", "need").agg(F.countDistinct("key").alias("n_found")).where(F.col("n_found") >= F.col("need"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n")).alias("containment"), F.col("n"), F.col("n_found"))).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.n").cast("long").alias("n_shingles"), F.col("x.n_found").cast("long").alias("n_found"), F.col("x.containment").alias("containment"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; rows with a null id stay. An empty benchmark leaves all rows."""
    bad = cut(leaks(docs, bench, id_col, text).select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(sized(bad, bad.count(), 16), id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
z AS (SELECT DISTINCT least(len(w), 5) AS k FROM u WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM t, z, unnest(range(1, len(w) - k + 2)) AS r(i)),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM u, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS k FROM b JOIN d USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_found, k / n AS containment
FROM f JOIN n USING (item_id) WHERE k >= ceil(0.8 * n - 1e-9)
"""
