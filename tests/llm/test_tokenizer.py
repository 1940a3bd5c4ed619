import random

import pytest

from tidemark.llm import tokenizer as T

ODD = ["a", "B", "é", "ß", "İ", "Σ", "ς", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "　", ",", "!!", "'s", "'T", "12", "½", "́", "日本", "<|endoftext|>", "​", "\x01", "_", "ª", "\xad", "ſ", "😀"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_ids_as_the_library(name, monkeypatch):
    r = random.Random(3)
    texts = [None, "", " ", *("".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(5_000))]
    want = [[*e.ids, T.END_ID] for e in T.Encoder(T.public(name)).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in T.Encoder(T.public(name)).encode(texts)] == want
    monkeypatch.setattr(T, "CACHE_BYTES", 5_000)  # words are dropped again and again
    monkeypatch.setattr(T, "_BATCH_CHARS", 2_000)
    assert [x.tolist() for x in T.Encoder(T.public(name)).encode(texts)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_plain_texts_of_many_words(name, monkeypatch):
    r = random.Random(4)
    parts = ["the", "Straße", "été", "don't", "l'été", "A1b22", "_x_", "--", "(a)", "<|endoftext|>", "\n", "\n\n", " ", "  ", "\t", " \n", "\r\n", "\xa1", "ÄÖ", "x" * 40]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 60))) for _ in range(2_000)]
    texts += ["\n", " ", "  ", "a\n", "a \n", "a\n\n\nb", "a  ", "\x01", "a\x01b"]
    monkeypatch.setattr(T, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(T, "_BATCH_CHARS", 5_000)
    want = [[*e.ids, T.END_ID] for e in T.Encoder(T.public(name)).tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in T.Encoder(T.public(name)).encode(texts)] == want


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(T, "CACHE_BYTES", 50_000)
    monkeypatch.setattr(T, "_BATCH_CHARS", 2_000)
    enc = T.Encoder(T.public("byte_bpe_50k.json"))
    for _ in enc.encode(f"w{i} v{i}" for i in range(20_000)):
        assert len(enc.cache.new) + len(enc.cache.old) < 2 * (50_000 + 2 * 2_000 * 210) // 200
