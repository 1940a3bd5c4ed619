import pytest

from tidemark.functions import declared as D
from tidemark.operators import curation as C


def said(text):
    return [(d.marker, d.subject, [t[1] for t in d.targets], d.row, d.itself) for d in D.declarations(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This document supersedes `docs/a.md`, b.md and c.md.", ("supersedes", None, ["docs/a.md", "b.md", "c.md"], None, True)),
        ("Status: superseded by docs/new.md", ("superseded_by", None, ["docs/new.md"], None, True)),
        ("D-012 supersedes D-003 / D-004.", ("supersedes", ("row", "D-012"), ["D-003", "D-004"], None, False)),
        ("Note: D-012 has now been replaced by the much better D-013", ("replaced_by", ("row", "D-012"), ["D-013"], None, False)),
        ("D-050 | 2024-01-02 | accepted | supersedes D-036", ("supersedes", None, ["D-036"], "D-050", True)),
        ("Dieses Dokument ersetzt a.md und b.md", ("supersedes", None, ["a.md", "b.md"], None, True)),
        ("Diese Seite wurde abgelöst durch neu.md", ("superseded_by", None, ["neu.md"], None, True)),
        ('This page replaces "The old plan".', ("replaces", None, ["The old plan"], None, True)),
        ("Bu belge a.md ve b.md geçersiz kılar", ("supersedes", None, ["a.md", "b.md"], None, True)),
        ("merged from draft-a.md & draft-b.md", ("merged_from", None, ["draft-a.md", "draft-b.md"], None, True)),
        ("The other team replaces x.md", ("replaces", None, ["x.md"], None, False)),
        ("a.md is merged into b.md", ("merged_into", ("path", "a.md"), ["b.md"], None, False)),
    ],
)
def test_clauses(text, want):
    assert said(text) == [want]


@pytest.mark.parametrize(
    "text",
    [
        "It never supersedes a.md", "This would replace a.md: it replaces nothing", "It may supersede a.md", "Does it supersede a.md?", "```\nsupersedes a.md\n```", "> supersedes a.md", "`supersedes a.md`", "supersedes everything that was ever written in file a.md",
        "supersedes D-001–D-005", "this is replaced", "supersedes", "", "wenn es a.md ersetzt", "~~~\nreplaces a.md",
    ],
)
def test_what_declares_nothing(text):
    assert said(text) == []


def test_sections_and_more_than_one_in_a_text():
    got = D.declarations("This supersedes a.md section 3 and b.md. D-001 replaces D-002; this replaces c.md\n")
    assert [d.targets for d in got] == [(("path", "a.md", True), ("path", "b.md", False)), (("row", "D-002", False),), (("path", "c.md", False),)]
    assert D.candidates("../x/./a.md", "docs/sub/b.md") == ["../x/a.md", "docs/x/a.md"] and D.candidates("a.md", None) == ["a.md"]


def test_resolution_by_path_title_and_row(spark):
    items = [
        (1, "docs/one.md", "One", "This document supersedes two.md and nowhere.md. It is said that this page replaces docs/two.md"),
        (2, "docs/two.md", "Twice", "D-001 | x\nthis document is replaced by \"One\""),
        (3, "three.md", "Twice", "D-002 | a | supersedes D-001\nD-003 | b | supersedes D-002\nD-004 | c | replaces three.md"),
        (4, None, "Four", "Replaces D-001. This page replaces \"Twice\". This page replaces \"Four\". Nobody replaces three.md. D-009 supersedes three.md. D-001 supersedes three.md section 2."),
        (5, "five.md", None, None),
        (6, "six.md", "Six", "D-004 | again\nsuperseded by D-004"),
    ]
    frame = spark.createDataFrame(items, "key long, path string, title string, body string")
    got = sorted((r.key, r.n, r.k, r.newer, r.older, r.scope, r.outcome) for r in C.resolve(C.declarations(frame), frame).collect())
    assert [(x[0], *x[3:]) for x in got] == [
        (1, 1, 2, "whole", "link"), (1, None, None, None, "unknown-target"), (1, None, None, None, "no-subject"),
        (2, 1, 2, "whole", "link"),
        (3, 3, 2, "part", "link"), (3, None, None, None, "self"), (3, None, None, None, "self"),
        (4, None, None, None, "row-by-text"), (4, None, None, None, "ambiguous-target"), (4, None, None, None, "self"), (4, None, None, None, "no-subject"), (4, None, None, None, "unknown-subject"), (4, 2, 3, "part", "link"),
        (6, None, None, None, "ambiguous-target"),
    ]
