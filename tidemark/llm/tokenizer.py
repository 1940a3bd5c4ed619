"""Whole-text encoding with the tokenizers library, faster by a bounded cache of encoded words in each Python worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 2
#: Unicode white space. A text is cut before a run of it that follows anything else, where no token of these vocabularies crosses.
_WS = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Texts of other than printable ASCII and Latin letters, or with longer runs of white space, are not cut by _cutter's pattern.
_ODD = r"[^\t\n\r !-~\x{A1}-\x{12F}\x{131}-\x{24F}]|[\t\n\r ]{3}|[\t\n\r ]{2}$"
_MARK = "\x01"
#: Words encoded as one text, and texts at once.
_JOIN, _TEXTS = 50, 400
#: Most bytes of a generation of cached words in a worker (there are two), what a word costs beside its letters and ids, and most characters cut up at once.
CACHE_BYTES, _WORD_BYTES, _BATCH_CHARS = 64 << 20, 200, 4_000_000
_ENCODERS: dict[str, Encoder] = {}


def _in_bytes(spec: dict) -> dict:
    """A byte-level vocabulary with each byte written as the Latin-1 letter of its number, as bytes.decode("latin-1") has it.

    In the file printable bytes stand for themselves and the others, in order, for the letters from number 256 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = {256 + i: b for i, b in enumerate(b for b in range(256) if b not in own)}
    vocab = {t.translate(letters): i for t, i in spec["model"]["vocab"].items()}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return spec["model"] | {"vocab": vocab, "merges": [[x.translate(letters), y.translate(letters)] for x, y in pairs]}


class Cache:
    """Ids of words as bytes. Words not used since a generation was full are dropped, so memory is bounded by bytes and frequent words stay."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def missing(self, words: list[str]) -> list[str]:
        out, new, old = [], self.new, self.old
        for w in [w for w in words if w not in new]:
            v = old.get(w)
            if v is None:
                out.append(w)
            else:
                self._put(w, v)
        return out

    def _put(self, w: str, v: bytes) -> None:
        self.new[w] = v
        self.bytes += len(w) + len(v) + _WORD_BYTES

    def put(self, words: list[str], ids: Iterable[bytes]) -> None:
        for w, v in zip(words, ids, strict=True):
            self._put(w, v)

    def turn(self) -> None:
        """Call between batches, when no word of a batch is wanted any more."""
        if self.bytes > CACHE_BYTES:
            self.new, self.old, self.bytes = {}, self.new, 0


class Encoder:
    """Ids of whole texts, each followed by END_ID; special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([END_ID], self.dtype)
        self.cache = Cache()
        spec = json.loads(self.tokenizer.to_str())
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.lower = "Lowercase" in str(spec["normalizer"])
        self.pattern = self._cutter(spec)
        if self.pattern:
            # the same merges on words that are already cut, lower-cased and written in bytes
            gap = {"type": "Split", "pattern": {"String": " " if self.suffix else "\n"}, "behavior": "Removed" if self.suffix else "Isolated", "invert": False}
            self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": gap, "added_tokens": [], "model": _in_bytes(spec)}))
            self.ends = np.zeros(size, bool)
            for token, i in self.words.get_vocab().items():
                self.ends[i] = token.endswith(self.suffix) if self.suffix else token == "\n"

    @staticmethod
    def _cutter(spec: dict) -> str | None:
        """The vocabulary's own pattern of words, if it is one of two known kinds. White space of at most two characters before
        anything else (see _ODD) is cut into single ones by both forms of the byte-level pattern."""
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"] or {}])
        if spec["model"].get("end_of_word_suffix") and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed":
            return steps[0]["pattern"]["Regex"]
        if steps[0]["type"] == "ByteLevel" and steps[0]["use_regex"] and spec["normalizer"] is None:
            return public_pattern().replace(r"\s+(?!\S)|\s+", r"\s")
        return None

    def _fill(self, words: list[str]) -> None:
        """Words that the pattern cut, into the cache. Many are encoded as one text; the last token of each shows where it ends."""
        if self.suffix:
            many = [w for w in words if w.strip()]
            self.cache.put([w for w in words if not w.strip()], (b"" for w in words if not w.strip()))
        else:
            many = [w for w in words if "\n" not in w and w]
            self._single([w for w in words if "\n" in w or not w])
        gap = " " if self.suffix else "\n"
        step = self.dtype.itemsize
        for i in range(0, len(many), _JOIN * _TEXTS):
            part = many[i : i + _JOIN * _TEXTS]
            bare = [w.strip() for w in part] if self.suffix else part
            joined = (gap.join([*bare[k : k + _JOIN], ""]) for k in range(0, len(bare), _JOIN))
            found = self.words.encode_batch_fast([t.encode("utf-8").decode("latin-1") for t in joined], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in found])
            at = np.flatnonzero(self.ends[ids])
            if len(at) != len(part):  # not the words that the pattern told
                self._single(part)
                continue
            raw, at = ids.tobytes(), at * step
            stop = at + step if self.suffix else at
            start = np.r_[0, at[:-1] + step]
            self.cache.put(part, [raw[x:y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)])

    def _single(self, texts: list[str]) -> None:
        for i in range(0, len(texts), 20_000):
            part = texts[i : i + 20_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.cache.put(part, [np.array(e.ids, self.dtype).tobytes() for e in found])

    def _ids(self, units: pa.Array, counts: np.ndarray, known: bool) -> Iterator[np.ndarray]:
        """The ids of texts, which are runs of ``counts`` units; ``known``: the pattern cut them."""
        coded = units.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = self.cache.missing(names)
        self._fill(missing) if known else self._single(missing)
        ids = pa.array([self.cache.new[w] for w in names], pa.large_binary()).take(coded.indices)
        flat = np.frombuffer(ids.buffers()[2] or b"", self.dtype)
        at = np.frombuffer(ids.buffers()[1], np.int64) // self.dtype.itemsize
        bounds = at[np.r_[0, np.cumsum(counts)]].tolist()
        for x, y in zip(bounds, bounds[1:], strict=False):
            yield np.concatenate([flat[x:y], self.end])

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _ODD) if self.pattern else pa.array([True] * len(texts))
        other = odd.to_numpy(zero_copy_only=False)
        plain = column.filter(pc.invert(odd))
        cut = iter(())
        if len(plain):
            plain = pc.utf8_lower(plain) if self.lower else plain
            lists = pc.split_pattern(pc.replace_substring_regex(plain, self.pattern, r"\0" + _MARK), _MARK)
            cut = self._ids(lists.flatten(), np.diff(lists.offsets.to_numpy()), True)
        rest = iter(())
        if other.any():
            pieces = [_PIECE.findall(t) for t, o in zip(texts, other, strict=True) if o]
            rest = self._ids(pa.array([p for t in pieces for p in t], pa.large_string()), np.array([len(p) for p in pieces]), False)
        for o in other.tolist():
            yield next(rest if o else cut)
        self.cache.turn()

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        batch, n = [], 0
        for t in texts:
            batch.append(t or "")
            n += len(batch[-1])
            if n >= _BATCH_CHARS:
                yield from self._some(batch)
                batch, n = [], 0
        if batch:
            yield from self._some(batch)


def encoder(path: str) -> Encoder:
    """One encoder for each path and worker process; it outlives tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    """How byte-level vocabularies cut a text into words."""
    import public_tokenizers

    return public_tokenizers.PATTERN
