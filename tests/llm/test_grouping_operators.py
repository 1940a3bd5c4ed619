"""Small cases of SimHash, suffix dedup, sharding, id files, packing and toxicity against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from tidemark.llm import components, idfile, packing, sharding, simhash, suffixes, tokenizer, toxicity

WORDS = [f"w{i}" for i in range(400)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, fp string, `__key` int")


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(a) for a in range(n)]


def test_simhash(spark):
    r = random.Random(1)
    base = [[r.choice(WORDS) for _ in range(r.randrange(1, 400))] for _ in range(12)]
    texts = [None, "", " \n ", "A b", "a B"]
    for b in base:
        for _ in range(5):
            w = list(b)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w).upper() if r.random() < 0.2 else "\t".join(w))
    texts.append(" ".join(r.choice(WORDS) for _ in range(60_000)))
    d = table(spark, list(enumerate(texts)) + [(0, None), (None, "A b")])
    f = [brute_fingerprint(t) for t in texts]
    want = roots(len(f), [(a, b) for a in range(len(f)) for b in range(a) if bin(f[a] ^ f[b]).count("1") <= 2])
    got = simhash.report(d).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        k = 3 if x.doc_id is None else x.doc_id
        assert (x.fingerprint, x.component_id) == (f"{f[k]:016x}", want[k])
    kept = simhash.keep_first(d).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted({k for k in range(len(f)) if want[k] == k})
    assert not simhash.report(d.limit(0)).collect()


@pytest.mark.parametrize("most", [50_000, 4])
def test_gray_index_links_connect_what_all_pairs_connect(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "NODE_MAX", most)
    g = np.random.default_rng(2)
    codes = {int(x) for x in g.integers(0, 2**64, 150, dtype=np.uint64)}
    for b in list(codes)[:30]:
        for _ in range(15):
            x = b
            for k in g.integers(0, 64, g.integers(1, 5)):
                x ^= 1 << int(k)
            codes.add(x)
    codes = sorted(np.array(sorted(codes), np.uint64).view(np.int64).tolist())
    u = np.array(codes).view(np.uint64)
    a, b = np.triu_indices(len(u), 1)
    m = np.bitwise_count(u[a] ^ u[b]) <= 2
    want = roots(len(u), list(zip(a[m].tolist(), b[m].tolist(), strict=True)))
    label = {x.node: x.root for x in components.connected(simhash.links(spark.createDataFrame([(c,) for c in codes], "fp long"))).collect()}
    assert [label.get(c, c) for c in codes] == [codes[k] for k in want]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7), (200, 200)], "a long, b long")
    got = {x.node: x.root for x in components.connected(e).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def brute_suffixes(texts):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot,node", [(64, 2000), (1, 2000), (1, 1)])
def test_suffixes(spark, monkeypatch, hot, node):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "NODE_MAX", node)
    monkeypatch.setattr(suffixes, "SAMPLE", 2)
    r = random.Random(3)
    base = "".join(r.choice("abcdefgé ") for _ in range(1500))
    texts = ["-" * 3000, "abc" * 500, "x" * 99, "x" * 100, "", None, "-" * 150 + "abc" * 60, base * 3]
    for _ in range(40):
        a = r.randrange(1000)
        texts.append("".join(r.choice("xyz") for _ in range(r.randrange(150))) + base[a : a + r.randrange(90, 400)] + "".join(r.choice("xyz") for _ in range(r.randrange(150))))
    texts = list(enumerate(texts))
    want = brute_suffixes(texts)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.report(table(spark, texts)).collect()}
    assert got == want
    assert not suffixes.report(table(spark, texts).limit(0)).collect()
    twice = suffixes.report(table(spark, [(1, base), (1, base), (None, base)])).collect()
    assert sorted((x.doc_id is None, x.n_removed == 0) for x in twice) == [(False, False), (False, False), (True, True)]


@pytest.mark.parametrize("mask", [2**64 - 1, 2**64 - 2**61])
def test_a_window_has_the_same_anchor_in_every_batch(monkeypatch, mask):
    mixed = suffixes._mixed
    monkeypatch.setattr(suffixes, "_mixed", lambda h: mixed(h) & np.uint64(mask))  # few bits: ties
    g = np.random.default_rng(5)
    filler = g.integers(97, 123, 3 << 20, dtype=np.uint8).tobytes()
    for _ in range(20):
        w = g.integers(97, 100, 100, dtype=np.uint8).tobytes()
        alone, inside = suffixes.runs([w]), suffixes.runs([filler, w])
        last = inside[0] == 1
        assert all((a == b[last]).all() for a, b in zip(alone[1:], inside[1:], strict=True))


def test_suffix_sort_orders_windows():
    g = np.random.default_rng(4)
    data = g.integers(97, 99, 3000, dtype=np.uint8)
    data[1000:1400] = data[:400]
    at, group = np.sort(g.choice(2900, 700, replace=False)), np.repeat(np.arange(7), 100)
    order = suffixes.SuffixSort(data).order(at, group)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(700), key=lambda k: (group[k], raw[at[k] : at[k] + 100], k))


def test_sharding(spark):
    texts = [(i, None if i % 7 == 0 else "é" * (i % 50)) for i in range(3000)] + [(None, "n"), (None, "n"), (5, "again")]
    d = table(spark, texts)
    got = sharding.shard(d).collect()
    assert len(got) == len(texts)
    by_id = {}
    for x in got:
        t = "again" if x.doc_id == 5 and x.size == 13 else (dict(texts[:3000]).get(x.doc_id, "n") or "")
        assert (x.size, x.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        assert x.grown_shard in (x.shard, 24)
        assert by_id.setdefault(x.doc_id, x.shard) == x.shard
    for s in range(24):
        own = [x for x in got if x.shard == s]
        assert sorted(x.slot for x in own) == list(range(len(own))) and 60 < len(own) < 200
    assert not sharding.shard(d.limit(0)).collect()
    ids = spark.range(20_000)
    from pyspark.sql import functions as F

    w = [1.0] * 24
    heavy = w[:5] + [3.0] + w[6:]
    none = w[:7] + [0.0] + w[8:]
    at = {n: sharding.descend(F.col("id"), 24, v).alias(n) for n, v in (("a", w), ("b", heavy), ("c", none))}
    x = ids.select("id", *at.values()).toPandas()
    moved = x[x.a != x.b]
    assert 0.1 < (x.b == 5).mean() < 0.13 and set(moved.b // 12) == {0}  # what moves goes into the region that weighs more
    inside = moved[moved.a // 12 == 0]
    assert set(inside.b // 4) == {1} and set(inside[inside.a // 4 == 1].b) == {5}
    out = x[x.a != x.c]
    assert 7 not in set(x.c) and set(out.a // 12) == {0} and set(out[out.a // 4 != 1].c // 12) == {1}
    for i, a, b, c in x.head(300).itertuples(index=False):
        assert (a, b, c) == (plain_descent(i, 24, w), plain_descent(i, 24, heavy), plain_descent(i, 24, none))
    assert sharding.tree(26)[0][2:] == [[6], [7]] and sharding.tree(5)[1] == [[0, 1, 2, 3], [4]]


def test_id_files(spark, tmp_path):
    g = np.random.default_rng(5)
    for top in (2, 300, 50_000, 2**32 - 1):
        docs = [(i, g.integers(0, top, g.integers(0, 900), dtype=np.uint32)) for i in range(60)] + [(99, g.integers(0, top, 700_000, dtype=np.uint32))]
        name = f"{tmp_path}/{top}.ids"
        idfile.write_file(name, iter(docs))
        back = list(idfile.read_file(name))
        assert [a for a, _ in back] == [a for a, _ in docs] and all((x[1] == y[1]).all() for x, y in zip(back, docs, strict=True))
    texts = [(3, "Hello world, hello!"), (1, None), (2, ""), (None, "null id"), (9, "long " * 30_000), (4, "<|endoftext|> é 😀\n\n x")]
    tk = tokenizer.Encoder(tokenizer.public("byte_bpe_50k.json")).tokenizer
    want, start = [], 0
    for i, t in sorted(texts, key=lambda x: -1 if x[0] is None else x[0]):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, idfile.round_trip(table(spark, texts)).collect()), key=lambda x: x[1]) == want
    assert not idfile.round_trip(table(spark, texts).limit(0)).collect()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    r = random.Random(6)
    parts = [" ", "\n", "\t", "  ", " ", "　", "\r\n", "a", "B", "é", "é", "'s", "don't", "1", "23", "$", "!?", "日本", "\x1c", "İ", "Σ", "word", "_", "ﬁ", "😀", "​", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(1500)] + ["", None, "  ", "\n\n"]
    enc = tokenizer.Encoder(tokenizer.public(name))
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert got.tolist() == [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_packing(spark):
    r = random.Random(7)
    texts = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([3, 40, 300])))) for i in range(300)] + [(1000, "many words " * 9000), (1001, None), (1002, ""), (None, "x"), (5, "again")]
    got = packing.sequences(table(spark, texts)).toPandas()
    size = got.groupby("sequence_id").length.sum()
    assert size.max() <= 4096 and (4096 - size).sum() < 4096 + 0.05 * size.sum()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length.to_numpy())[:-1]]).all() and len(g) <= packing.MAX_SEGMENTS
    enc = tokenizer.Encoder(tokenizer.public("word_bpe_49k.json"))
    long = next(iter(enc.encode(["many words " * 9000]))).astype("<u4")
    own = got[got.doc_id == 1000].sort_values("start")
    assert [zlib.crc32(long[s : s + n]) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist() and own.length.sum() == len(long)
    assert not packing.sequences(table(spark, texts).limit(0)).collect()


def test_dot_product_bins_keep_every_limit():
    g = np.random.default_rng(8)
    demand = np.stack([g.integers(1, 60, 400), np.ones(400, int), g.integers(0, 30, 400)], axis=1)
    limit = np.array([100, 5, 40])
    where, place = packing.dot_product_bins(demand, limit)
    for b in range(where.max() + 1):
        assert (demand[where == b].sum(axis=0) <= limit).all() and sorted(place[where == b]) == list(range((where == b).sum()))
    assert where.max() + 1 <= 1.15 * max(np.ceil(demand.sum(axis=0) / limit))


def naive_bins(demand, limit):
    """The heuristic as it is told: item by item, in exact fractions."""
    from fractions import Fraction

    left, bins = list(range(len(demand))), []
    room = list(limit)
    while left:
        fits = [i for i in left if all(d <= r for d, r in zip(demand[i], room, strict=True))]
        if not fits:
            room = list(limit)
            bins.append([])
            continue
        bins = bins or [[]]
        best = max(fits, key=lambda i: (sum(Fraction(d * r, x * x) for d, r, x in zip(demand[i], room, limit, strict=True)), [-d for d in demand[i]], -i))
        bins[-1].append(best)
        room = [r - d for r, d in zip(room, demand[best], strict=True)]
        left.remove(best)
    return bins


def test_dot_product_bins_are_those_of_the_naive_greedy():
    g = np.random.default_rng(11)
    limit = [64, 4, 32]  # powers of two: products of shares are exact
    demand = [[int(a), 1, int(g.integers(0, min(a, 30)))] for a in g.integers(1, 60, 150)]
    where, place = packing.dot_product_bins(np.array(demand), np.array(limit))
    want = naive_bins(demand, limit)
    got = [sorted(np.flatnonzero(where == b).tolist(), key=lambda i: place[i]) for b in range(where.max() + 1)]
    assert [[demand[i] for i in b] for b in got] == [[demand[i] for i in b] for b in want]


def test_instruction_packing_keeps_a_loss_limit_that_binds(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("key", packing.F.lit(1))
    n = turns.count()
    limits = (512, 16, 128)
    got = packing.instruction_sequences(turns, limits=limits).toPandas()
    by = got.groupby("sequence_id").agg(n=("length", "sum"), s=("length", "size"), l=("loss", "sum"))
    assert (by.n <= 512).all() and (by.s <= 16).all() and (by.l <= 128).all() and (by.l == 128).any() | (by.l > 100).sum() > 3
    assert len(got[got.start == 0]) == n and (got.loss == got.length.where(got.role == "assistant", 0)).all()
    assert not packing.instruction_sequences(turns.limit(0)).collect()


def test_toxicity_gradient():
    net = toxicity.Network(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = np.random.default_rng(9)
    x, mask = g.standard_normal((5, 4, toxicity.DIM_WORD + toxicity.DIM_CHAR)), (np.arange(5)[:, None] < [5, 4, 3, 1])[:, :, None]
    up = g.standard_normal(4)
    _, tape = net.forward(x, mask, keep=True)
    grads, _ = net.backward(up, tape)
    for k in ("Wf", "Ub", "Nf", "A", "v", "w", "Bb"):
        at = tuple(int(g.integers(0, n)) for n in net.p[k].shape)
        old = net.p[k][at]
        f = []
        for e in (1e-3, -1e-3):
            net.p[k][at] = old + e
            f.append(float((net.forward(x, mask) * up).sum()))
        net.p[k][at] = old
        assert abs((f[0] - f[1]) / 2e-3 - grads[k].reshape(net.p[k].shape)[at]) < 1e-3


def test_toxicity_learns_and_scores_whole_texts(spark):
    r = random.Random(10)
    bad = ["vileword", "nastyish", "nastyoid"]
    texts, labels = [], []
    for i in range(400):
        w = [r.choice(WORDS) for _ in range(r.randrange(20, 120))]
        y = int(i % 3 == 0)
        for _ in range(3 * y):
            w[r.randrange(len(w))] = r.choice(bad)
        texts.append((i, " ".join(w)))
        labels.append((i, y))
    d, l = table(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.fit(d, l)
    more = [(9000, None), (9001, ""), (9002, " ".join(r.choice(WORDS) for _ in range(20_000))), (9003, " ".join([*(r.choice(WORDS) for _ in range(5000)), "nastyish vileword nastyoid"])), (None, "w1 w2")]
    got = {x.doc_id: x for x in toxicity.score(table(spark, texts + more), m).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(got[i].held_out for i, _ in labels) == len(held)
    assert sum(got[i].predicted == y for i, y in labels if got[i].held_out) >= 0.9 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values()) and got[9000].score < 0.5 and got[9001].score < 0.5
    assert got[9003].predicted == 1 and len(got) == len(texts) + len(more)


def plain_descent(key, shards, weights):
    """Region, rack and shard by one draw after the other; shards beyond 24 are regions."""
    tree = [[[r * 12 + k * 4 + s for s in range(4)] for k in range(3)] for r in range(2)] + [[[s]] for s in range(24, shards)]
    flat = lambda x: [x] if isinstance(x, int) else [s for y in x for s in flat(y)]
    numbers = {}
    for level in range(3):
        nodes = tree if level == 0 else [k for r in tree for k in r] if level == 1 else [s for r in tree for k in r for s in k]
        numbers |= {(level, str(x)): i for i, x in enumerate(nodes)}
    at = tree
    for level in range(3):
        draws = []
        for node in at:
            h = 42
            for value, size in ((level, 4), (numbers[level, str(node)], 4), (key % (1 << 64), 8)):
                h = xxhash.xxh64_intdigest(value.to_bytes(size, "little"), h)
            rate = sum(weights[s] for s in flat(node))
            draws.append(-np.log(((h >> 11) + 1) / ((1 << 53) + 1)) / rate if rate else np.inf)
        at = at[int(np.argmin(draws))]
    return at


def test_sharding_as_plain_draws(spark):
    ids = [0, 1, 2, -5, 10**12, *range(100, 400)]
    got = {x.doc_id: x for x in sharding.shard(table(spark, [(i, f"text {i}") for i in ids])).collect()}
    assert all(got[i].shard == plain_descent(i, 24, [1.0] * 24) and got[i].grown_shard == plain_descent(i, 25, [1.0] * 25) for i in ids)
    for s in range(24):
        own = sorted((x for x in got.values() if x.shard == s), key=lambda x: x.doc_id)
        assert [x.slot for x in own] == list(range(len(own)))


def plain_logit(net, vectors):
    """The network over one window, one word after the other."""
    p, h = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    both = []
    for s, order in (("f", range(len(vectors))), ("b", range(len(vectors) - 1, -1, -1))):
        state, out = np.zeros(h), {}
        for t in order:
            x = vectors[t] @ p[f"W{s}"] + p[f"B{s}"]
            z, r = sig(x[:h] + state @ p[f"U{s}"][:, :h]), sig(x[h : 2 * h] + state @ p[f"U{s}"][:, h:])
            n = np.tanh(x[2 * h :] + r * (state @ p[f"N{s}"]))
            state = (1 - z) * n + z * state
            out[t] = state
        both.append([out[t] for t in range(len(vectors))])
    states = np.concatenate([np.array(both[0]), np.array(both[1])], axis=1)
    e = np.exp([float(np.tanh(x @ p["A"] + p["a"]) @ p["v"][:, 0]) for x in states])
    pooled = (e[:, None] * states).sum(axis=0) / e.sum()
    return float(pooled @ p["w"][:, 0] + p["b"][0])


def test_toxicity_as_one_window_after_the_other(spark):
    r = random.Random(4)
    net = toxicity.Network(5)
    model = toxicity.Model({w: i + 1 for i, w in enumerate(WORDS[:4])}, net, 0.1)
    model.scale, model.shift = 1.7, -0.3
    texts = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (1, 2, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 3 * toxicity.WINDOW + 7)]
    got = [x.score for x in sorted(toxicity.score(table(spark, list(enumerate(texts))), model).collect(), key=lambda x: x.doc_id)]
    for text, score in zip(texts, got, strict=True):
        words = toxicity.split_words(text)
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)
        worst = max(plain_logit(net, model.vectors_of(words[a : a + toxicity.WINDOW]).astype(float)) for a in starts)
        assert abs(score - 1 / (1 + np.exp(-(model.scale * worst + model.shift)))) < 1e-4
