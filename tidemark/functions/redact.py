"""Secrets in texts and JSON values replaced by stable placeholders, in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from tidemark.functions.text import RULES, over

_NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|passwort|kennwort|parola|şifre|sifre"
#: Fixed values: (kind, pattern, group that holds the secret), special kinds before general ones.
SECRETS = (
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[^-]|-(?!----END))*(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?", 0),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0),
    ("github_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})", 0),
    ("google_key", r"\b(?:AIza[0-9A-Za-z_-]{30,}|ya29\.[0-9A-Za-z_-]{20,})", 0),
    ("slack_token", r"\bxox[abprs]-[0-9A-Za-z-]{10,}|https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", 0),
    ("stripe_key", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0),
    ("model_key", r"\bsk-[A-Za-z0-9_-]{20,}", 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    ("bearer", r"(?i)\bbearer\s+([A-Za-z0-9._~+/=-]{16,})", 1),
    ("dsn_password", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:([^\s@/]{1,256})@", 1),
    ("assignment", rf"(?i)(?:{_NAMES})\w{{0,2}}[\"']?\s*(?::|=>?|\bis\b|\bist\b)\s*[\"'`]?([^\s\"'`,;]{{8,}})", 1),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", 0),
)
_COMPILED = [(k, re.compile(p), g) for k, p, g in SECRETS]
_MASKS = [(k, re.compile(p)) for k, p in RULES]
_REFERENCE = re.compile(r"env:|\$\{|<|\.{0,2}/|(?:\*+|x+|changeme|none|null|true|false)$", re.IGNORECASE)
_PLACEHOLDER = re.compile(r"(⟦[a-z_]+:[0-9a-f]{8}⟧)")
_COLON = re.compile(r"\s*:")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def iban(text: str) -> bool:
    """Whether the check digits are right: letters count from 10, and the number with its first four places put last leaves 1 over 97."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _is_secret(kind: str, value: str) -> bool:
    if kind == "iban":
        return iban(value)
    if kind != "assignment":
        return True
    # names of places where a secret is kept, and prose, are none
    return not _REFERENCE.match(value) and (len(value) >= 16 or any(c.isdigit() for c in value))


def placeholder(kind: str, secret: str) -> str:
    return f"⟦{kind}:{hashlib.sha256(secret.encode()).hexdigest()[:8]}⟧"


def redact(text: str) -> str:
    """``text`` with each secret as its kind and a digest, the same for the same secret. What has been replaced, now or before, is not looked at again."""
    parts = [(p, i % 2 == 1) for i, p in enumerate(_PLACEHOLDER.split(text))]
    for kind, pattern, group in _COMPILED:
        out = []
        for part, done in parts:
            at = 0
            for m in () if done else pattern.finditer(part):
                if _is_secret(kind, m[group]):
                    out += [(part[at : m.start(group)], False), (placeholder(kind, m[group]), True)]
                    at = m.end(group)
            out.append((part[at:], done))
        parts = [p for p in out if p[0]]
    return "".join(p for p, _ in parts)


def mask(text: str) -> str:
    """As ``text.mask``: every finding as its rule's name in brackets."""
    for kind, pattern in _MASKS:
        text = pattern.sub(f"[{kind}]", text)
    return text


def each_string(value: str, change: Callable[[str], str]) -> str:
    """JSON text with ``change`` made to its strings, wherever they stand; keys, numbers, blanks and shape stay. What is no JSON is changed as one text."""
    try:
        json.loads(value)
    except (ValueError, RecursionError):
        return change(value)

    def one(m: re.Match) -> str:
        if _COLON.match(value, m.end()):
            return m[0]
        was = json.loads(m[0], strict=False)
        now = change(was)
        return m[0] if now == was else json.dumps(now, ensure_ascii=False)

    return _STRING.sub(one, value)


redacted, redacted_json, masked_json = over(redact), over(lambda t: each_string(t, redact)), over(lambda t: each_string(t, mask))
