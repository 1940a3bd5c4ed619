"""Cover density and word similarity against counts over all runs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexicon as L


def covers(words, groups):
    """Σ over runs of places that hold a whole group and no shorter run that does."""
    has = lambda run, g: all(any(words[i].startswith(t) for i in run) for t in g)
    whole = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if any(has(range(a, b + 1), g) for g in groups)]
    least = [(a, b) for a, b in whole if not any(a <= c and d <= b and (c, d) != (a, b) for c, d in whole)]
    hit = [any(w.startswith(t) for g in groups for t in g) for w in words]
    return sum(0.1 / (1 + (b - a) - (sum(hit[a : b + 1]) - 1)) for a, b in least)


def frames(spark, docs, queries):
    chunks = spark.createDataFrame([(i, i * 1000, w) for i, w in docs.items()], "doc_id long, chunk_id long, words array<string>")
    idx = L.index(chunks)
    terms = [(q, "+".join(g), len(g), t) for q, gs in queries.items() for g in gs for t in g]
    return chunks, idx, spark.createDataFrame(terms, "qid int, grp string, m int, term string")


def test_cover_density_of_or_and_prefixes(spark):
    r = random.Random(9)
    vocabulary = ["a", "ab", "abc", "b", "ba", "c", "ca", "d", "x", "y", "z"]
    docs = {i: [r.choice(vocabulary) for _ in range(r.randrange(0, 14))] for i in range(80)}
    queries = {1: [("a",)], 2: [("a",), ("ba",)], 3: [("a", "b")], 4: [("ab", "c", "d")], 5: [("a", "d"), ("c",)], 6: [("ab", "ca"), ("b", "d"), ("z", "nowhere")], 7: [("nowhere",)], 8: [("a", "ab")]}
    _, idx, terms = frames(spark, docs, queries)
    got = {(x.qid, x.doc_id): x.score for x in L.cover_density(idx, L.expand(L.vocabulary(idx), terms)).collect()}
    want = {(q, i): round(s / (s + 1), 6) for q, gs in queries.items() for i, w in docs.items() for s in [covers(w, gs)] if s}
    assert {q for q, _ in want} == set(range(1, 9)) - {7}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def similarity(term, text):
    own, run = set(L._sequence(term)), L._sequence(text)
    return max((len(own & set(run[a:b])) / len(own | set(run[a:b])) for a in range(len(run)) for b in range(a + 1, len(run) + 1)), default=0.0) if own else 0.0


def test_word_similarity_finds_every_chunk_from_few_candidates(spark):
    r = random.Random(6)
    syllables = ["ta", "ri", "mo", "ken", "zu", "al", "str", "öl", "ne", "vi"]
    words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 7))) for _ in range(300)]
    docs = {i: [r.choice(words) + r.choice(["", "", ".", "-x", "_y"]) for _ in range(r.randrange(1, 9))] for i in range(150)}
    terms = [w for w in words if len(w) >= 8][:20] + ["read_service.py", "tarimo ken", "x", ""]
    docs |= {900: ["see", "read", "service", "py"], 901: ["Read_Service.py!"], 902: ["read_services.py"], 903: []}
    chunks, idx, _ = frames(spark, docs, {})
    asked = spark.createDataFrame([(1 + i % 3, t) for i, t in enumerate(terms)], "qid int, term string")
    vocabulary = L.vocabulary(idx)
    got = {(x.qid, x.doc_id): x.score for x in L.trigram_similar(chunks, idx, vocabulary, asked).collect()}
    every = [(1 + k % 3, i, similarity(t, " ".join(w))) for k, t in enumerate(terms) for i, w in docs.items()]
    want: dict = {}
    for q, i, s in every:
        if s >= 0.9 - 1e-9:
            want[q, i] = max(want.get((q, i), 0), round(s, 6))
    assert len(want) > 20 and got == pytest.approx(want)
    assert L.similar_candidates(idx, vocabulary, asked).count() < 0.15 * len(every)  # ten syllables make all words, so even the rarest trigrams are common


def test_preview(spark):
    w = [f"w{i}" for i in range(30)]
    cases = [([], [], ""), (w[:3], ["w9"], "w0 w1 w2"), (w, ["x"], " ".join(w[:8])), (w, ["w20", "w22"], "… " + " ".join(w[18:26])), (w, ["w29"], "… " + " ".join(w[22:30])), (w, ["w1"], " ".join(w[:8]))]
    d = spark.createDataFrame(list(enumerate((a, b) for a, b, _ in cases)), "i int, x struct<w: array<string>, t: array<string>>")
    got = {x.i: x.p for x in d.select("i", L.preview(F.col("x.w"), F.col("x.t"), 8, 2).alias("p")).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(cases)}
