"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained in numpy.

A text's words are cut into windows of WINDOW words, each starting STEP words after the one before, so they overlap and cover the whole text. A word
enters as the vector of its form (if the training sample has it often enough) beside the mean of the vectors of its character sequences.
The text's score is that of its worst window, calibrated on the training sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import prepare

WINDOW, STEP = 32, 16
#: The training sample: at most so many texts of each label, of at most so many characters each, chosen by a hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 700, 1000, 20_000
#: Word forms that the sample has in so many texts, at most so many, get a vector of their own.
MIN_TEXTS, MAX_FORMS = 5, 8_000
DIM_WORD, DIM_CHAR, HIDDEN, ATTENTION = 12, 12, 12, 12
NGRAMS, TABLE = (3, 4, 5), 1 << 14
#: Passes over the sample, more of a small one, so that there are STEPS_MIN steps at least. In training a word is blanked with chance DROP.
EPOCHS, STEPS_MIN, BATCH, RATE, DROP, SEED = 3, 450, 256, 0.01, 0.3, 7
_WORD = re.compile(r"\w+")
_CACHE_MAX = 400_000


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def ngram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table for each word's sequences, one after the other, and where each word's begin. Every word has at least one."""
    raw = [b"<%b>" % w.encode("utf-8", "surrogatepass") for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(raw)), size)
    rows, owner = [], []
    for n in NGRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x100000001B3)
        ok = word[: len(h)] == word[n - 1 :]
        rows.append(((h ^ (h >> np.uint64(29))) % np.uint64(TABLE)).astype(np.int64)[ok])
        owner.append(word[: len(h)][ok])
    r, o = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    r, o = r[order], o[order]
    return r, np.searchsorted(o, np.arange(len(raw)))


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Start places of a text's windows."""
    n = len(ids)
    return np.arange(0, max(1, n - WINDOW + STEP), STEP) if n else np.zeros(0, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The weights, a forward pass over windows, and its gradient."""

    def __init__(self, forms: int, seed: int = SEED):
        g = np.random.default_rng(seed)
        d, h, a = DIM_WORD + DIM_CHAR, HIDDEN, ATTENTION
        init = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        zero = lambda *s: np.zeros(s, np.float32)
        self.p = {"form": (0.1 * g.standard_normal((forms, DIM_WORD))).astype(np.float32), "char": (0.3 * g.standard_normal((TABLE, DIM_CHAR))).astype(np.float32)}
        for s in "fb":
            self.p |= {f"W{s}": init(d, 3 * h), f"B{s}": zero(3 * h), f"U{s}": init(h, 2 * h), f"N{s}": init(h, h)}
        self.p |= {"A": init(2 * h, a), "a": zero(a), "v": init(a, 1), "w": init(2 * h, 1), "b": zero(1)}
        self.p["form"][0] = 0

    def _run(self, x: np.ndarray, mask: np.ndarray, s: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, B, H) of one direction; x (T, B, D), mask (T, B, 1)."""
        p, h = self.p, HIDDEN
        xp = x @ p[f"W{s}"] + p[f"B{s}"]
        steps = range(len(x)) if s == "f" else range(len(x) - 1, -1, -1)
        state = np.zeros((x.shape[1], h), np.float32)
        out, tape = np.empty((*x.shape[:2], h), np.float32), []
        for t in steps:
            zr = _sigmoid(xp[t, :, : 2 * h] + state @ p[f"U{s}"])
            z, r = zr[:, :h], zr[:, h:]
            nh = state @ p[f"N{s}"]
            n = np.tanh(xp[t, :, 2 * h :] + r * nh)
            new = np.where(mask[t], n + z * (state - n), state)
            if keep:
                tape.append((t, state, z, r, n, nh))
            state = new
            out[t] = state
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: x (T, B, D), mask (T, B, 1)."""
        p = self.p
        hf, tf = self._run(x, mask, "f", keep)
        hb, tb = self._run(x, mask, "b", keep)
        hs = np.concatenate([hf, hb], axis=2)
        s = np.tanh(hs @ p["A"] + p["a"])
        e = np.where(mask, s @ p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        c = (alpha * hs).sum(axis=0)
        logit = (c @ p["w"] + p["b"])[:, 0]
        return (logit, (x, mask, tf, tb, hs, s, alpha, c)) if keep else logit

    def backward(self, grad: np.ndarray, tape: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights, and of x, for a gradient of the logits."""
        p, h = self.p, HIDDEN
        x, mask, tf, tb, hs, s, alpha, c = tape
        g = {"w": c.T @ grad[:, None], "b": grad.sum(keepdims=True)}
        dc = grad[:, None] * p["w"].T
        dh = alpha * dc
        da = (hs * dc).sum(axis=2, keepdims=True)
        de = alpha * (da - (alpha * da).sum(axis=0))
        g["v"] = np.tensordot(s, de, ([0, 1], [0, 1]))
        ds = (de @ p["v"].T) * (1 - s * s)
        g["A"], g["a"] = np.tensordot(hs, ds, ([0, 1], [0, 1])), ds.sum(axis=(0, 1))
        dh = dh + ds @ p["A"].T
        dx = np.zeros_like(x)
        for name, own, steps in (("f", dh[:, :, :h], tf), ("b", dh[:, :, h:], tb)):
            dxp = np.zeros((*x.shape[:2], 3 * h), np.float32)
            gu, gn = np.zeros_like(p[f"U{name}"]), np.zeros_like(p[f"N{name}"])
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, state, z, r, n, nh in reversed(steps):
                d = own[t] + carry
                live = np.where(mask[t], d, 0)
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (state - n) * z * (1 - z)
                dr = dn * nh * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                dnh = dn * r
                dxp[t] = np.concatenate([dzr, dn], axis=1)
                gu += state.T @ dzr
                gn += state.T @ dnh
                carry = np.where(mask[t], live * z, d) + dzr @ p[f"U{name}"].T + dnh @ p[f"N{name}"].T
            g |= {f"W{name}": np.tensordot(x, dxp, ([0, 1], [0, 1])), f"B{name}": dxp.sum(axis=(0, 1)), f"U{name}": gu, f"N{name}": gn}
            dx += dxp @ p[f"W{name}"].T
        return g, dx


class Model:
    """What executors need: the network, the word forms and the calibration."""

    def __init__(self, forms: dict[str, int], net: Network, prior: float):
        self.forms, self.net, self.prior = forms, net, prior
        self.scale, self.shift = 1.0, 0.0
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((0, DIM_WORD + DIM_CHAR), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "vectors": np.zeros((0, DIM_WORD + DIM_CHAR), np.float32)}

    def vectors_of(self, words: list[str]) -> np.ndarray:
        rows, at = ngram_rows(words)
        size = np.diff(np.r_[at, len(rows)])
        char = np.add.reduceat(self.net.p["char"][rows], at, axis=0) / size[:, None]
        form = self.net.p["form"][[self.forms.get(w, 0) for w in words]]
        return np.concatenate([form, char], axis=1).astype(np.float32)

    def _ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list(dict.fromkeys(w for t in texts for w in t if w not in self.known))
        if len(self.known) + len(new) > _CACHE_MAX:
            self.known, self.vectors = {}, self.vectors[:0]
            new = list(dict.fromkeys(w for t in texts for w in t))
        if new:
            base = len(self.known)
            self.known |= {w: base + i for i, w in enumerate(new)}
            made = self.vectors_of(new)
            if base + len(new) > len(self.vectors):
                room = np.zeros((max(1 << 14, 2 * (base + len(new))), made.shape[1]), np.float32)
                room[:base] = self.vectors[:base]
                self.vectors = room
            self.vectors[base : base + len(new)] = made
        get = self.known.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def worst(self, texts: list[list[str]], most: int = 2048) -> np.ndarray:
        """The largest window logit of each text; -inf without words."""
        out = np.full(len(texts), -np.inf)
        ids = self._ids(texts)
        starts = [windows_of(i) for i in ids]
        n = np.array([len(s) for s in starts])
        if not n.sum():
            return out
        size = np.array([len(i) for i in ids])
        first = np.cumsum(size) - size
        flat = np.concatenate(ids)
        owner = np.repeat(np.arange(len(ids)), n)
        begin = np.concatenate(starts)
        for k in range(0, len(owner), most):
            o, b = owner[k : k + most], begin[k : k + most]
            step = b[None, :] + np.arange(WINDOW)[:, None]
            mask = step < size[o]
            at = flat[np.where(mask, step + first[o], 0)]
            logit = self.net.forward(self.vectors[at], mask[:, :, None])
            np.maximum.at(out, o, logit)
        return out

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        w = self.worst(texts)
        return np.where(np.isfinite(w), _sigmoid(self.scale * np.where(np.isfinite(w), w, 0) + self.shift), self.prior)


def train(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """Fit on a sample in memory; ``share`` is that of toxic texts where the sample comes from. A fourth of the texts is kept to calibrate on. Windows first take their text's label; then toxic texts keep only the windows that look toxic."""
    words = [split_words(t) for t in texts]
    y = np.array(labels, np.float32)
    df = Counter(w for t in words for w in set(t))
    forms = {w: i + 1 for i, (w, c) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0]))[:MAX_FORMS]) if c >= MIN_TEXTS}
    net = Network(len(forms) + 1)
    prior = float(y.mean()) if len(y) else 0.0
    share = prior if share is None else share
    model = Model(forms, net, min(share, 0.49))
    if not len(y) or prior in (0.0, 1.0):
        model.scale, model.shift = 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return model
    # every fourth text of each label is kept from training, to calibrate on
    order = np.argsort(-y, kind="stable")
    aside = np.zeros(len(y), bool)
    aside[order[3::4]] = True
    if len(set(y[aside])) < 2:
        aside[:] = False
    rest, rest_y = [t for t, x in zip(words, aside, strict=True) if x], y[aside]
    words, y = [t for t, x in zip(words, aside, strict=True) if not x], y[~aside]
    df = Counter(w for t in words for w in set(t))
    names = list(df)
    number = {w: i for i, w in enumerate(names)}
    ids = [np.array([number[w] for w in t], np.int64) for t in words]
    rows, at = ngram_rows(names)
    size = np.diff(np.r_[at, len(rows)])
    form = np.array([forms.get(w, 0) for w in names])
    owner = np.concatenate([np.full(len(windows_of(i)), k) for k, i in enumerate(ids)])
    begin = np.concatenate([windows_of(i) for i in ids])
    g = np.random.default_rng(SEED)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    use, tick = np.arange(len(owner)), 0
    epochs = max(EPOCHS, -(-STEPS_MIN // max(1, len(owner) // BATCH)))
    for epoch in range(epochs):
        if epoch and epoch % max(1, epochs // 3) == 0:  # toxic texts: the windows that the network holds for toxic, the worst at least
            model.known, model.vectors = {}, model.vectors[:0]
            logit = np.concatenate([_window_logits(model, ids, names, owner[k : k + 4096], begin[k : k + 4096]) for k in range(0, len(owner), 4096)])
            top = np.full(len(ids), -np.inf)
            np.maximum.at(top, owner, logit)
            use = np.flatnonzero((y[owner] == 0) | (logit >= np.minimum(top[owner], 1.0)))
        for part in np.array_split(g.permutation(use), max(1, len(use) // BATCH)):
            tick += 1
            o, b = owner[part], begin[part]
            step = b[None, :] + np.arange(WINDOW)[:, None]
            n = np.array([len(ids[k]) for k in o])
            mask = step < n
            tok = np.zeros(step.shape, np.int64)
            for j, k in enumerate(o):
                tok[: mask[:, j].sum(), j] = ids[k][b[j] : b[j] + WINDOW]
            uniq, back = np.unique(tok, return_inverse=True)
            r = np.concatenate([rows[at[u] : at[u] + size[u]] for u in uniq])
            cut_at = np.cumsum(size[uniq]) - size[uniq]
            char = np.add.reduceat(net.p["char"][r], cut_at, axis=0) / size[uniq][:, None]
            x = np.concatenate([net.p["form"][form[uniq]], char], axis=1).astype(np.float32)[back.reshape(tok.shape)]
            seen = (g.random(tok.shape) >= DROP).astype(np.float32)[:, :, None]
            x = x * seen
            logit, tape = net.forward(x, mask[:, :, None], keep=True)
            grads, dx = net.backward(((_sigmoid(logit) - y[o]) / len(o)).astype(np.float32), tape)
            dx = np.where(mask[:, :, None], dx * seen, 0).reshape(-1, dx.shape[2])
            per = np.stack([np.bincount(back.ravel(), dx[:, c], len(uniq)) for c in range(dx.shape[1])], axis=1)
            grads["form"] = np.zeros_like(net.p["form"])
            np.add.at(grads["form"], form[uniq], per[:, :DIM_WORD])
            grads["form"][0] = 0
            spread = np.repeat(per[:, DIM_WORD:] / size[uniq][:, None], size[uniq], axis=0)
            grads["char"] = np.stack([np.bincount(r, spread[:, c], TABLE) for c in range(DIM_CHAR)], axis=1)
            for k, d in grads.items():
                d = d.astype(np.float32).reshape(net.p[k].shape)
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                net.p[k] -= RATE * (m[k] / (1 - 0.9**tick)) / (np.sqrt(v[k] / (1 - 0.99**tick)) + 1e-7)
    model.known, model.vectors = {}, model.vectors[:0]
    if len(rest):
        words, y = rest, rest_y
    w = np.nan_to_num(model.worst(words), neginf=-20.0)
    target = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))  # Platt's targets
    weight = np.where(y > 0, share / prior, (1 - share) / (1 - prior))
    z = np.stack([w, np.ones_like(w)], axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(z @ ab)
        step = np.linalg.solve((z * (weight * q * (1 - q))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (weight * (target - q)))
        ab = ab + np.clip(step, -1, 1)
    a, b = ab.tolist()
    model.scale, model.shift = max(a, 0.05), b
    model.known, model.vectors = {}, model.vectors[:0]
    return model


def _window_logits(model: Model, ids: list[np.ndarray], names: list[str], owner: np.ndarray, begin: np.ndarray) -> np.ndarray:
    step = begin[None, :] + np.arange(WINDOW)[:, None]
    mask = step < np.array([len(ids[k]) for k in owner])
    tok = np.zeros(step.shape, np.int64)
    for j, k in enumerate(owner):
        tok[: mask[:, j].sum(), j] = ids[k][begin[j] : begin[j] + WINDOW]
    uniq, back = np.unique(tok, return_inverse=True)
    return model.net.forward(model.vectors_of([names[u] for u in uniq])[back.reshape(tok.shape)], mask[:, :, None])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on the sample of labelled rows that are not held out. Ids with several labels take the largest; nulls are left out."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).alias("y"))
    counts = own.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    pick = lambda y, n: own.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n)
    chosen = pick(1, SAMPLE_TOXIC).unionAll(pick(0, SAMPLE_CLEAN))
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["__id"]).where(F.length(text) <= SAMPLE_CHARS)
    sample = rows.select("__id", F.col(text).alias("text"), F.col("y").cast("int").alias("y")).dropDuplicates(["__id"]).toPandas().sort_values("__id")
    return train(sample["text"].tolist(), sample["y"].tolist(), counts[0] / max(1, sum(counts)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score, predicted. Texts without words get the sample's share of toxic texts (below 0.5)."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                s = m.scores([split_words(t) for t in b.column(2).to_pylist()])
                yield pa.record_batch([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
