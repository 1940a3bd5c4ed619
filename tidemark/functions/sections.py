"""Markdown texts cut into sections: decision rows, dated headings, and parts of what is too long."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, replace

#: What a heading, a fence, a dated record and a decision row look like, and front matter.
HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"\s*(```|~~~)")
DATED = re.compile(r"(?:session\s+)?(\d{4}-\d{2}-\d{2})(?=$|[\s—–:|,.)-])", re.IGNORECASE)
DECISION = re.compile(r"(D-\d{3,4}) \| (\d{4}-\d{2}-\d{2}) \| ")
FRONT = re.compile(r"---\n(.*?)\n---\n", re.DOTALL)
#: Characters of a section beyond which it is cut.
LONG = 8000


@dataclass(frozen=True)
class Section:
    """A part of a text. ``anchor`` is null for the text's main part; ``evidence`` says what the date comes from."""

    anchor: str | None
    lead: str | None
    date: str | None
    evidence: str
    kind: str
    body: str


@dataclass(frozen=True)
class Line:
    """A line with its end, and if it is a heading outside fences its level and title."""

    text: str
    level: int = 0
    title: str = ""


def _slug(text: str, most: int = 48) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")[:most] or "section"


def _day(text: str) -> str | None:
    try:
        return datetime.date.fromisoformat(text).isoformat()
    except ValueError:
        return None


def lines(text: str) -> list[Line]:
    """All lines; a fence is open until a line with the same mark."""
    out, fence = [], None
    for raw in text.splitlines(keepends=True):
        f, h = FENCE.match(raw), HEADING.match(raw.rstrip("\n"))
        if f:
            fence = None if fence == f[1] else fence or f[1]
        out.append(Line(raw, len(h[1]), h[2]) if h and not f and fence is None else Line(raw))
    return out


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(fields of one line each, the text behind them)."""
    m = FRONT.match(text)
    if not m:
        return {}, text
    pairs = (x.partition(":") for x in m[1].split("\n"))
    return {k.strip(): v.strip().strip("\"'") for k, colon, v in pairs if colon and not k.startswith((" ", "#", "-"))}, text[m.end() :]


def _text(part: list[Line]) -> str:
    return "".join(x.text for x in part)


def _cut(all_lines: list[Line], starts: list[int]) -> list[list[Line]]:
    """Pieces before the first start and from each start to the next; the first may be empty."""
    ends = [*starts, len(all_lines)]
    return [all_lines[: ends[0]], *(all_lines[a:b] for a, b in zip(starts, ends[1:], strict=True))]


def _decisions(all_lines: list[Line]) -> list[Section] | None:
    """A section for each row of a decision log of two rows or more; lines up to the next row belong to it."""
    starts = [i for i, x in enumerate(all_lines) if DECISION.match(x.text)]
    if len(starts) < 2:
        return None
    first, *rows = _cut(all_lines, starts)
    out = [Section(None, None, None, "none", "fact", _text(first))]
    for r in rows:
        m, cells = DECISION.match(r[0].text), [c.strip() for c in r[0].text.split(" | ")]
        what = re.sub(r"[*`]", "", cells[3]) if len(cells) > 3 else ""
        out.append(Section(m[1], f"{m[1]} · {cells[2] if len(cells) > 2 else ''}: {what}".strip()[:150], _day(m[2]), "decision-row", "fact", _text(r)))
    return out


def _records(all_lines: list[Line]) -> tuple[list[Section] | None, str | None]:
    """Sections of dated headings of the highest level that has one, each to the next or to a higher heading; or the date of a text whose first heading is its only dated one."""
    headings = [(i, x) for i, x in enumerate(all_lines) if x.level]
    dated = [(i, x, d) for i, x in headings for m in [DATED.match(x.title)] if m for d in [_day(m[1])] if d]
    if not dated:
        return None, None
    if len(dated) == 1 and dated[0][0] == headings[0][0]:
        return None, dated[0][2]
    level = min(x.level for _, x, _ in dated)
    day = {i: d for i, x, d in dated if x.level == level}
    first, *rest = _cut(all_lines, sorted({*day, *(i for i, x in headings if x.level < level and i > min(day))}))
    out = [Section(None, None, None, "none", "note", _text(first))]
    title = ""
    for part in rest:
        m = DATED.match(part[0].title) if part[0].level == level else None
        if m and _day(m[1]):
            title = part[0].title
            out.append(Section(_slug(title), title, _day(m[1]), "dated-heading", "episode", _text(part)))
        else:
            out.append(Section(f"after-{_slug(title, 40)}", part[0].title, None, "none", "note", _text(part)))
    return out, None


def _short(s: Section, part: list[Line], level: int, most: int | None) -> list[Section]:
    """``s`` cut at the headings of the highest level below which all of it gets shorter, each long piece again a level deeper, and at last between lines or within one."""
    if most is None or len(s.body) <= most:
        return [s]
    for depth in range(level, 7):
        starts = [i for i, x in enumerate(part) if i and 0 < x.level <= depth]
        if starts:
            out = []
            for k, piece in enumerate(_cut(part, starts)):
                own = replace(s, body=_text(piece)) if k == 0 else replace(s, anchor="~".join(filter(None, [s.anchor, _slug(piece[0].title)])), lead=" › ".join(filter(None, [s.lead, piece[0].title])), body=_text(piece))
                out += _short(own, piece, depth + 1, most)
            return out
    out, rest = [], s.body
    while rest:
        at = len(rest) if len(rest) <= most else next((x for x in (rest.rfind("\n\n", 0, most) + 2, rest.rfind("\n", 0, most) + 1) if x > most // 2), most)
        out.append(replace(s, body=rest[:at], anchor=s.anchor if not out else "~".join(filter(None, [s.anchor, f"part-{len(out) + 1}"]))))
        rest = rest[at:]
    return out


def sections(text: str, most: int | None = LONG) -> list[Section]:
    """The sections of a text in order, whose bodies together are the text behind its front matter. Blank ones are left out; anchors that come again are numbered."""
    fields, body = front_matter(text)
    all_lines = lines(body)
    own = _day(fields.get("date", ""))
    found = _decisions(all_lines)
    if found is None:
        found, of_file = _records(all_lines)
        if found is None:
            day = own or of_file
            found = [Section(None, None, day, "front-matter" if own else "dated-heading" if of_file else "none", fields.get("type", "note"), body)]
    out, seen = [], {}
    for s in found:
        for x in _short(s, lines(s.body), 1, most):
            if x.body.strip():
                n = seen[x.anchor] = seen.get(x.anchor, 0) + 1
                out.append(x if n == 1 else replace(x, anchor=f"{x.anchor or 'main'}-{n}"))
    return out
