"""What a text declares superseded: clauses with a marker, a subject and targets."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

#: Fixed values. Marker phrases: (words, name, whether the targets are the newer side, whether they stand before it).
MARKERS = (
    (("superseded", "by"), "superseded_by", True, False),
    (("supersedes",), "supersedes", False, False),
    (("supersede",), "supersedes", False, False),
    (("superseding",), "supersedes", False, False),
    (("replaced", "by"), "replaced_by", True, False),
    (("replaced", "with"), "replaced_by", True, False),
    (("replaces",), "replaces", False, False),
    (("replacing",), "replaces", False, False),
    (("merged", "into"), "merged_into", True, False),
    (("merged", "from"), "merged_from", False, False),
    (("ersetzt", "durch"), "superseded_by", True, False),
    (("abgelöst", "durch"), "superseded_by", True, False),
    (("abgelöst", "von"), "superseded_by", True, False),
    (("ersetzt",), "supersedes", False, False),
    (("geçersiz", "kılar"), "supersedes", False, True),
    (("yerini", "alır"), "replaces", False, True),
)
#: Words before a marker with which it declares nothing, words that may stand between a subject and its marker, and words that mean the text itself.
DENIAL = frozenset("not no never cannot can't don't doesn't won't nicht kein keine keinen niemals nie değil asla".split())
DOUBT = frozenset("would could should may might can will shall if whether unless propose proposes proposed suggests maybe perhaps würde könnte sollte falls wenn ob vielleicht eğer belki".split())
AUXILIARY = frozenset("is was are were has have had been being now hereby also thereby fully partly officially then ist wurde wird sind hat nun jetzt".split())
ITSELF = frozenset("this the present document doc file spec note page report version draft plan status dieses diese dieser dokument datei seite bericht fassung hinweis bu belge dosya sayfa rapor".split())
JOINS = frozenset((",", "/", "&", "and", "und", "sowie", "ve", "ile"))
SECTIONS = frozenset(("§", "section", "sections", "abschnitt", "bölüm"))
#: Words that may stand between a marker and its first target.
LEAD = 5

ROW = re.compile(r"(D-\d{3,})[ \t]*\|")
_SOME = re.compile("|".join(dict.fromkeys(m[0][0] for m in MARKERS)), re.IGNORECASE)
_FENCE = re.compile(r"[ \t]*(```|~~~)")
_RANGE = re.compile(r"D-\d{3,}\s*(?:\.\.\.?|–|—|-|\bto\b|\bbis\b)\s*D-\d{3,}")
_TOKEN = re.compile(r"(?P<row>(?<![\w-])D-\d{3,}(?!\w))|(?P<path>(?:\.{1,2}/)?(?:[\w@-][\w.@-]*/)*[\w@-][\w.@-]*\.(?:md|txt|rst|adoc)\b)(?:#[\w.-]*)?|[\"“](?P<title>[^\"“”\n]{3,120})[\"”]|(?P<join>[,/&§])|(?P<word>[\w'’]+)|(?P<end>[()|:])")


@dataclass(frozen=True)
class Declaration:
    """``subject`` is (kind, value) or null for the row or text that declares; ``targets`` are (kind, value, whether only a section of it)."""

    marker: str
    reverse: bool
    subject: tuple[str, str] | None
    row: str | None
    itself: bool
    targets: tuple[tuple[str, str, bool], ...]
    clause: str


def _clauses(body: str):
    """(row, clause) of lines outside fences and quotes; a clause ends with a sentence, a line, or a semicolon, and a question is none."""
    fence = None
    for line in body.split("\n"):
        mark = _FENCE.match(line)
        if mark:
            fence = None if fence == mark[1] else fence or mark[1]
        elif fence is None and not line.lstrip().startswith(">") and _SOME.search(line):
            row = ROW.match(line)
            # code that isn't a name alone is left out
            line = re.sub(r"`([^`]*)`", lambda m: m[1] if re.fullmatch(r"[\w./@#-]*[./-][\w./@#-]*", m[1]) else " ", line)
            for part in re.split(r"(?<=[.!?;])\s+", line):
                if not part.rstrip().endswith("?"):
                    yield row[1] if row else None, part.strip()


def _tokens(clause: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(_RANGE.sub(" | ", clause)):
        kind = m.lastgroup
        out.append((kind, m[kind] if kind != "word" else m[kind].lower().replace("’", "'")))
    return out


def _is_ref(t: tuple[str, str]) -> bool:
    return t[0] in ("row", "path", "title")


def _list(tokens: list[tuple[str, str]], most: int) -> list[tuple[str, str, bool]]:
    """The references that begin a token list, after at most so many words: one, and others that are joined to it."""
    at = next((i for i, t in enumerate(tokens) if t[0] != "word"), len(tokens))
    out: list[tuple[str, str, bool]] = []
    if at > most:
        return out
    while at < len(tokens) and _is_ref(tokens[at]):
        section = at + 1 < len(tokens) and tokens[at + 1][1] in SECTIONS
        out.append((*tokens[at], section))
        at += 1
        if section:
            at += 1
            while at < len(tokens) and tokens[at][0] == "word" and tokens[at][1] not in JOINS:
                at += 1
        joined = at
        while joined < len(tokens) and tokens[joined][1] in JOINS:
            joined += 1
        if joined == at:
            break
        at = joined
    return out


def declarations(body: str) -> list[Declaration]:
    """All declarations of a text, in order. Denied, doubted and asked ones declare nothing, nor do markers without a target."""
    out = []
    for row, clause in _clauses(body):
        tokens = _tokens(clause)
        words = [v if k == "word" else None for k, v in tokens]
        i = 0
        while i < len(tokens):
            hit = next((m for m in MARKERS if tuple(words[i : i + len(m[0])]) == m[0]), None)
            if hit is None:
                i += 1
                continue
            phrase, name, reverse, before = hit
            head, tail = tokens[:i], tokens[i + len(phrase) :]
            i += len(phrase)
            near = [v for k, v in head if k == "word"][-3:]
            if set(near) & (DENIAL | DOUBT):
                continue
            if before:
                first = len(head)
                while first and (_is_ref(head[first - 1]) or head[first - 1][1] in JOINS or len(head[first - 1][1]) <= 3 and first < len(head) and head[first - 1][0] == "word"):
                    first -= 1
                targets = _list([t for t in head[first:] if _is_ref(t) or t[1] in JOINS], 0)
                head = head[:first]
            else:
                targets = _list(tail, LEAD)
            if not targets:
                continue
            own = head[2:] if row and head[:1] == [("row", row)] else head  # the row's own name and bar
            opened = max((k for k, t in enumerate(own) if t[0] == "end"), default=-1)
            own = own[opened + 1 :]
            while own and own[-1][1] in AUXILIARY:
                own = own[:-1]
            subject = own[-1] if own and _is_ref(own[-1]) else None
            out.append(Declaration(name, reverse, subject, row, all(t[1] in ITSELF for t in own), tuple(targets), clause))
    return out


def candidates(ref: str, path: str | None) -> list[str]:
    """The paths that a reference may mean: from the root, and from the folder of the text that names it."""
    found = [posixpath.normpath(ref)]
    if path:
        found.append(posixpath.normpath(posixpath.join(posixpath.dirname(path), ref)))
    return list(dict.fromkeys(found))
